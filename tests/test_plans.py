"""Scale properties of the physical plans (checked with explain, not timing)."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from furrow.functions.ids import dense_ids
from furrow.functions.ordered_window import ordered_window
from furrow.operators import search as S
from furrow.operators import conflicts as C
from furrow.operators.joins import range_join
from furrow.sources.tables import load

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_insert_ignore_reads_only_key_columns_of_existing(spark):
    li = load(spark, SF, "lineitem")
    existing = load(spark, SF, "lineitem")
    p = plan(C.insert_ignore(existing.where("l_shipdate < '1996-01-01'"), li,
                             ["l_orderkey", "l_linenumber"], ["l_partkey"]))
    scans = [set(c.split(",")) for c in re.findall(r"FileScan parquet \[([^\]]*)\]", p)]
    cols = [{c.split("#")[0] for c in scan} for scan in scans]
    assert {"l_orderkey", "l_linenumber", "l_shipdate"} in cols


def test_ordered_window_carry_is_broadcast(spark):
    o = load(spark, SF, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    p = plan(ordered_window(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                            running_sums={"rs": "o_totalprice"}))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_bm25_top_k_without_full_sort(spark):
    p = plan(S.bm25(load(spark, SF, "documents"), ["the"], k=5))
    assert "TakeOrderedAndProject" in p


def test_cube_scans_only_needed_lineitem_columns(spark):
    p = plan(E.queries()["cube_revenue_by_nation_month"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p


def test_range_join_is_an_equi_join(spark):
    ev = load(spark, SF, "events").select("event_id", "ts")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    ranges = (ev.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
              .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("s"))
              .withColumn("e", F.col("s") + F.expr("INTERVAL 1 HOUR")))
    p = plan(range_join(ev, ranges, "ts", "s", "e", 3600))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_dense_ids_never_funnel_rows_through_one_partition(spark):
    o = load(spark, SF, "orders").select("o_orderkey", "o_custkey")
    p = plan(dense_ids(o, ["o_orderkey"]))
    # the only single-partition exchange sits above the per-chunk counts
    for m in re.finditer(r"Exchange SinglePartition", p):
        below = p[m.end():m.end() + 400]
        assert "_chunk" in below


def test_first_seen_aggregates_partially_before_the_shuffle(spark):
    li = load(spark, "/root/testdata/sf0.1", "lineitem")
    # a plain scan, not repartitioned: hot keys collapse below the only exchange
    p = plan(C.first_seen(li, ["l_orderkey", "l_linenumber"], ["l_partkey"]))
    assert "partial_min_by" in p                             # hot keys collapse map-side
