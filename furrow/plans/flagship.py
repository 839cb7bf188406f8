"""The flagship query: normalise F1, join facts to the dimension, top 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import normalize as N
from furrow.sources import feeds


def customer_revenue(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    res = N.normalize(feeds.orders_feed(spark, sf), "sales_orders", "o_orderkey")
    per = (res.fact.groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("orders"),
                F.round(F.sum("o_totalprice"), 2).alias("revenue")))
    return (per.join(res.customers, per.customer_id == res.customers.id)
            .select("customer_id", "name", "email", "orders", "revenue")
            .orderBy(F.desc("revenue"), "customer_id")
            .limit(k))
