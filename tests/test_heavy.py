"""Frequent values in bounded space."""

import random
from collections import Counter

from pyspark.sql import functions as F

from furrow.operators import heavy as H


def words(spark, n=40_000, parts=6):
    rng = random.Random(3)
    rows = [(i % 9, f"w{int(rng.paretovariate(0.6)) % 30_000}") for i in range(n)]
    return Counter(w for _, w in rows), spark.createDataFrame(rows, "g int, w string").repartition(parts)


def test_counts_keep_the_stated_error(spark):
    exact, df = words(spark)
    for tracked in (50, 500):
        bound = H.error_share(tracked) * sum(exact.values())
        by_group = H.summaries(df, ["w"], ["g"], tracked)
        top = H.top_values(H.merged(by_group, tracked=tracked), 40).collect()
        assert all(abs(r["count"] - exact[r["value"]]) <= bound for r in top)
        frequent = {w for w, c in exact.items() if c > 2 * bound}
        assert frequent <= {r["value"] for r in top} and [r["rank"] for r in top] == list(range(1, len(top) + 1))
        assert {r["rows"] for r in top} == {sum(exact.values())}


def test_exact_top_says_whether_it_is_certain(spark):
    exact, df = words(spark)
    want = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]
    got = H.exact_top(df, "w", 5).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in got] == want and all(r["certain"] for r in got)
    flat = spark.range(20_000).select((F.col("id") % 10_000).cast("string").alias("w"))
    assert not any(r["certain"] for r in H.exact_top(flat, "w", 5, tracked=20).collect())
    few = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "w string")
    assert [(r["value"], r["count"], r["certain"]) for r in H.exact_top(few, "w", 5).orderBy("rank").collect()] == [("a", 2, True), ("b", 1, True)]
    assert H.exact_top(few.where("w IS NULL"), "w", 5).collect() == []
