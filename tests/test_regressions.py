"""Cases that were once answered wrongly."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.ordered_window import ordered_window
from furrow.operators import normalize as N
from furrow.operators import conflicts as C
from furrow.operators import sink as K
from furrow.operators import timeseries as TS
from furrow.plans.seed import _merge_dim
from furrow.sources.feeds import orders_feed

SF = "/root/testdata/sf0.001"


def test_running_sum_over_nulls(spark):
    rows = [(i % 2, i, None if i < 120 or i % 3 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): r.s for r in ordered_window(df, ["k"], ["o"], running_sums={"s": "v"}, chunks=6).collect()}
    for k in (0, 1):
        total = None
        for kk, o, v in rows:
            if kk == k:
                total = v if total is None else total + (v or 0)
                assert got[k, o] == total


def test_fill_gaps_keeps_the_null_series(spark):
    ts = [dt.datetime(2024, 1, d) for d in (1, 3)]
    df = spark.createDataFrame([(None, ts[0]), (None, ts[0]), ("a", ts[1])], "s string, ts timestamp_ntz")
    agg = TS.aggregate_series(df, "ts", "day", ["s"], {"n": F.count(F.lit(1))})
    out = TS.fill_gaps(agg, "day", ["s"], {"n": 0})
    assert out.columns == ["s", "bucket", "n"]
    got = {(r.s, r.bucket.day): r.n for r in out.collect()}
    assert got == {(None, 1): 2, (None, 2): 0, (None, 3): 0, ("a", 1): 0, ("a", 2): 0, ("a", 3): 1}


def test_previous_period_must_be_adjacent(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 10.0), (8, 11.0), (22, 5.0))], "s string, bucket date, v double")
    out = TS.period_over_period(df, ["s"], "v", "week").orderBy("bucket").collect()
    assert [(r.previous, r.change) for r in out] == [(None, None), (10.0, 1.0), (None, None)]
    months = spark.createDataFrame([("a", dt.date(2024, m, 1), float(m)) for m in (1, 2, 3)], "s string, bucket date, v double")
    assert [r.previous for r in TS.period_over_period(months, ["s"], "v", "month").orderBy("bucket").collect()] == [None, 1.0, 2.0]


def test_wall_clock_times_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = dt.datetime(2024, 3, 10, 2, 30, 15, 123456)  # an hour that clocks skip there
        df = spark.createDataFrame([(t,)], "ts timestamp_ntz")
        assert K.truncate_seconds(df).first()[0] == t.replace(microsecond=0)
        hour, week, month = df.select(*[TS.bucket(F.col("ts"), u).alias(u) for u in ("hour", "week", "month")]).first()
        assert hour == dt.datetime(2024, 3, 10, 2) and week == dt.date(2024, 3, 4) and month == dt.date(2024, 3, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


DIM = "id bigint, name string, email string, phone string"


def cands(spark, *emails):
    return spark.createDataFrame([(e, e, "", i) for i, e in enumerate(emails)], "email string, name string, phone string, first_seq int")


def test_dimension_ids_never_restart(spark, tmp_path):
    store = K.Store(spark, str(tmp_path))
    store.create_if_absent("d", T.StructType.fromDDL(DIM))
    store.replace("d", spark.createDataFrame([(1, "a", "a", ""), (2, "b", "b", "")], DIM))
    for emails in (("a", "b"), ("z",), ("y", "z")):
        _merge_dim(store, "d", cands(spark, *emails), "email", DIM)
    assert sorted((r.id, r.email) for r in store.read("d").collect()) == [(1, "a"), (2, "b"), (3, "z"), (4, "y")]


def test_building_a_plan_runs_no_job(spark):
    feed = orders_feed(spark, SF)  # parquet schemas are read here
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "no job expected")
    try:
        c = N.customer_candidates(feed, "o_orderkey")
        C.insert_ignore(c, C.insert_ignore(None, c, ["email"], ["first_seq"]), ["email"], ["first_seq"])
        assert list(tracker.getJobIdsForGroup("build-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_orders_without_a_customer_stay(spark):
    assert orders_feed(spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
