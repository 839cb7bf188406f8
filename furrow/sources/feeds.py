"""Flat feeds derived from the provided tables for the normaliser.

F1: orders joined to customer, shaped like ``sales_orders`` (customer_* columns
    denormalised on every order), ordered by ``o_orderkey``.
F2: part shaped like ``manufacturing_orders``: ``product_sku = p_name`` and
    ``product_name = p_type`` (several types per name, so first-seen matters).
F3: F1 with the natural key nulled / emptied on some rows (null-key rule).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.tables import load


def customer_email(c_name) -> F.Column:
    return F.concat(F.lower(F.replace(c_name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


def orders_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 (seq = o_orderkey). Orders without a customer stay, with null key."""
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                    F.col("c_name").alias("customer_name"),
                    customer_email(F.col("c_name")).alias("customer_email")))


def parts_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 (seq = p_partkey)."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", "p_size", "p_retailprice",
                    F.col("p_type").alias("product_name"), F.col("p_name").alias("product_sku"))


def orders_feed_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key null where o_orderkey % 17 = 0, empty where % 19 = 0 (all rows kept)."""
    f = orders_feed(spark, sf_dir)
    k = F.col("o_orderkey")
    return f.withColumn("customer_email",
                        F.when(k % 17 == 0, F.lit(None).cast("string"))
                        .when(k % 19 == 0, F.lit(""))
                        .otherwise(F.col("customer_email")))
