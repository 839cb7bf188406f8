"""The scale algorithms against brute force: dense ids, skew-safe windows,
exact quantiles, salted top-k, bucketed range join."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.functions.ids import dense_ids
from furrow.functions.ordered_window import ordered_window
from furrow.functions.quantiles import exact_quantiles
from furrow.functions.topk import top_k_per_group
from furrow.operators.joins import range_join


def _skewed(spark, n=6000, seed=3):
    rnd = random.Random(seed)
    # one key holds a third of all rows
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 300), rnd.randint(0, 10_000), i, float(rnd.randint(1, 99)))
            for i in range(n)]
    return spark.createDataFrame(rows, "g int, t int, id int, v double")


def test_dense_ids_match_row_number(spark):
    df = _skewed(spark).repartition(7)
    got = dense_ids(df, ["t", "id"], "rid").select("id", "rid")
    want = df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("rid"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_ordered_window_equals_plain_window(spark):
    df = _skewed(spark).repartition(5)
    got = ordered_window(df, ["g"], ["t", "id"], row_number="rn", rank="rk",
                         running_sums={"rs": "v"}, lags={"pv": "v"}, leads={"nv": "v"}, chunks=6)
    w = Window.partitionBy("g").orderBy("t", "id")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.rank().over(w).cast("bigint").alias("rk"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                     F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"))
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ordered_window_rank_with_ties(spark):
    df = spark.createDataFrame([(0, i // 10, i) for i in range(500)], "g int, t int, id int")
    got = ordered_window(df, ["g"], ["t"], rank="rk", chunks=4)
    want = df.select("*", F.rank().over(Window.partitionBy("g").orderBy("t")).cast("bigint").alias("rk"))
    assert got.exceptAll(want).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [float(rnd.choice([1, 1, 1, 2, 3, 7]) * rnd.randint(1, 50)) for _ in range(3000)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", float(i)) for i in range(11)], "g string, v double")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.95, 1.0], buckets=16).collect()}
    for p in [0.0, 0.25, 0.5, 0.95, 1.0]:
        assert abs(got[("a", p)] - float(np.quantile(vals, p))) < 1e-9
        assert abs(got[("b", p)] - float(np.quantile(range(11), p))) < 1e-9


def test_top_k_per_group_skewed(spark):
    df = _skewed(spark)
    got = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 3, salts=8)
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))
    want = df.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_range_join_matches_nested_loop(spark):
    base = dt.datetime(2024, 1, 1)
    pts = spark.createDataFrame([(i, base + dt.timedelta(minutes=7 * i)) for i in range(300)],
                                "pid int, ts timestamp_ntz")
    rng = spark.createDataFrame([(j, base + dt.timedelta(minutes=40 * j), base + dt.timedelta(minutes=40 * j + 95))
                                 for j in range(50)], "rid int, s timestamp_ntz, e timestamp_ntz")
    got = range_join(pts, rng, "ts", "s", "e", 1800).select("pid", "rid")
    want = pts.join(rng, (pts.ts >= rng.s) & (pts.ts < rng.e)).select("pid", "rid")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ordered_window_null_keys_and_single_chunk_keys(spark):
    rows = [(None if i % 5 == 0 else i % 7, i, float(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    got = ordered_window(df, ["g"], ["t"], row_number="rn", running_sums={"rs": "v"},
                         lags={"pv": "v"}, leads={"nv": "v"}, chunks=5)
    w = Window.partitionBy("g").orderBy("t")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                     F.lag("v").over(w).alias("pv"), F.lead("v").over(w).alias("nv"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dense_ids_hot_leading_value_and_string_keys(spark):
    rows = [(0 if i % 3 == 0 else i, f"k{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, s string").repartition(5)
    got = dense_ids(df, ["a", "s"], "rid", start=100, chunks=6).select("a", "s", "rid")
    want = df.select("a", "s", (F.row_number().over(Window.orderBy("a", "s")) + 99).alias("rid"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    only_strings = dense_ids(df.select("s"), ["s"], "rid", chunks=4)
    assert only_strings.agg(F.min("rid"), F.max("rid"), F.countDistinct("rid")).first() == (1, 3000, 3000)


def test_profile_approx_mode_close_to_exact(spark):
    from furrow.operators.profile import profile_numeric
    from furrow.sources.tables import load
    ev = load(spark, "/root/testdata/sf0.01", "events")
    exact = {r.column: r.distinct for r in profile_numeric(ev, "events", ["user_id", "value"]).collect()}
    approx = {r.column: r.distinct for r in
              profile_numeric(ev, "events", ["user_id", "value"], exact=False).collect()}
    for c in exact:
        assert abs(approx[c] - exact[c]) <= 0.1 * exact[c]


def test_quantiles_narrow_until_a_bucket_fits_one_task(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=3000).round(2).tolist() + list(range(2000))
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 1.0)] * 50 + [("c", None)], "g string, v double").repartition(5)
    for limit in (1, 7, 10_000):
        got = {(r.g, r.p): r.q for r in exact_quantiles(df, "g", "v", [0.0, 0.1, 0.5, 0.99, 1.0], buckets=4, limit=limit).collect()}
        assert set(got) == {(g, p) for g in "ab" for p in (0.0, 0.1, 0.5, 0.99, 1.0)}
        for p in (0.0, 0.1, 0.5, 0.99, 1.0):
            assert abs(got["a", p] - float(np.quantile(vals, p))) < 1e-9 and got["b", p] == 1.0


def test_profile_keeps_what_a_double_cannot(spark):
    from decimal import Decimal

    from furrow.operators.profile import profile_numeric
    big = 2 ** 53
    df = spark.createDataFrame([(big + i, Decimal(big) * 1000 + Decimal(i) / 100, i / 2, i) for i in range(4)] + [(None, None, None, None)],
                               "w bigint, d decimal(22,2), f double, i int").select("w", "d", "f", F.col("i").cast("int"))
    for exact in (True, False):
        got = {r["column"]: r for r in profile_numeric(df, "t", exact=exact).collect()}
        assert all(r["distinct"] == 4 and r["nulls"] == 1 and r["count"] == 4 for r in got.values())
        assert (got["w"]["min_text"], got["w"]["max_text"]) == (str(big), str(big + 3))
        assert (got["d"]["min_text"], got["d"]["max_text"]) == (f"{big * 1000}.00", f"{big * 1000}.03")
        assert got["f"]["min_text"] is None and (got["i"]["min_text"], got["i"]["p50"] in (1.0, 1.5)) == ("0", True)


def test_range_join_keeps_only_points(spark):
    import pytest
    points = spark.createDataFrame([(1,), (25,), (99,), (None,)], "x int")
    ranges = spark.createDataFrame([(0, 30, "a"), (20, 40, "b"), (50, 90, "c")], "s int, e int, n string")
    from furrow.operators.joins import range_join
    got = {h: sorted((tuple(r) for r in range_join(points, ranges, "x", "s", "e", 7, h, numeric=True).collect()), key=str)
           for h in ("inner", "left", "left_semi", "left_anti")}
    assert got["inner"] == [(1, 0, 30, "a"), (25, 0, 30, "a"), (25, 20, 40, "b")]
    assert len(got["left"]) == 5 and got["left_semi"] == [(1,), (25,)] and got["left_anti"] == [(99,), (None,)]
    for how in ("right", "full", "outer"):
        with pytest.raises(ValueError, match="unmatched ranges"):
            range_join(points, ranges, "x", "s", "e", 7, how, numeric=True)


def test_empty_suites_and_the_least_hash(spark):
    from furrow.operators.quality import run_suite
    df = spark.range(3)
    assert run_suite(df, []).collect() == [] and run_suite(df, []).columns == ["rule", "evaluated", "unexpected", "unexpected_pct", "success"]
    rows = top_k_per_group(spark.range(200).withColumn("g", F.col("id") % 3), ["g"], [F.desc("id")], 2, salts=3).collect()
    assert sorted((r.g, r.rank, r.id) for r in rows) == [(0, 1, 198), (0, 2, 195), (1, 1, 199), (1, 2, 196), (2, 1, 197), (2, 2, 194)]
