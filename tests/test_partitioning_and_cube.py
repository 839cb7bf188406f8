"""Partition independence of the load operators, and the cube API."""

import pytest
from pyspark.sql import functions as F

from furrow.operators import metrics as M
from furrow.operators import conflicts as C
from furrow.operators import sink as K
from furrow.sources.tables import load

SF = "/root/testdata/sf0.001"
KEY = ["l_orderkey", "l_linenumber"]


def _li(spark):
    return load(spark, SF, "lineitem")


def _rest(df):
    return [c for c in df.columns if c not in KEY]


@pytest.mark.parametrize("parts", [1, 7])
def test_insert_ignore_same_for_any_partitioning(spark, parts):
    li = _li(spark)
    base = C.insert_ignore(None, li.coalesce(1), KEY, _rest(li))
    other = C.insert_ignore(None, li.repartition(parts), KEY, _rest(li))
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_assign_ids_same_for_any_partitioning(spark, parts):
    li = _li(spark)
    acc = C.insert_ignore(None, li, KEY, _rest(li))
    a = K.assign_ids(acc.coalesce(1), KEY, 10).select("id", *KEY)
    b = K.assign_ids(acc.repartition(parts), KEY, 10).select("id", *KEY)
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.min("id"), F.max("id"), F.count("*")).first() == (11, 10 + acc.count(), acc.count())


def _cube(spark):
    o = load(spark, SF, "orders")
    return M.Cube(o, {"total": M.Measure("total", "sum", "o_totalprice"),
                      "orders": M.Measure("orders", "count"),
                      "avg_price": M.Measure("avg_price", "avg", "o_totalprice"),
                      "customers": M.Measure("customers", "count_distinct", "o_custkey")},
                  {"status": "o_orderstatus"}, time_dimension="o_orderdate")


def test_cube_query_with_filter_and_granularity(spark):
    c = _cube(spark)
    q = c.query(["orders", "total"], ["status"], "month", filters=["o_totalprice > 100000"])
    o = load(spark, SF, "orders").where("o_totalprice > 100000")
    assert q.agg(F.sum("orders")).first()[0] == o.count()
    assert set(q.columns) == {"status", "month", "orders", "total"}


def test_preaggregate_reuse_and_refusal(spark):
    c = _cube(spark)
    pre = c.preaggregate(["orders", "total", "avg_price"], ["status"], "month")
    by_year = pre.answer(["orders", "avg_price"], ["status"], "year")
    direct = c.query(["orders"], ["status"]).withColumnRenamed("orders", "direct")
    rolled = by_year.groupBy("status").agg(F.sum("orders").alias("rolled"))
    joined = rolled.join(direct, "status")
    assert joined.count() == direct.count() and joined.where("rolled != direct").count() == 0
    y = by_year.collect()[0]
    o = load(spark, SF, "orders").where((F.col("o_orderstatus") == y.status)
                                        & (F.year("o_orderdate") == y.year))
    assert abs(o.agg(F.avg("o_totalprice")).first()[0] - y.avg_price) < 1e-6
    with pytest.raises(ValueError):
        c.preaggregate(["customers"], ["status"], "month")
    with pytest.raises(ValueError):
        pre.answer(["orders"], ["status"], "hour")
