"""Exact quantiles (linear interpolation, like ``quantile_cont``) per group,
without gathering a group's values in one task.

1. ``histogram``: distinct (group, value) with multiplicity ``_w`` (partial
   aggregation, so a value repeated a billion times is one row per map task).
2. Per group, ``percentile_approx`` over the distinct values gives ``B - 1``
   cut points: equi-depth buckets of distinct values. They are a few hundred
   numbers per group, so they are broadcast: joined by the group, all values
   of a column would meet in one task. A value finds its bucket in two steps,
   among every ``STEP``-th cut and then among the cuts between two of these.
3. Bucket weights -> running start rank per bucket (``B`` rows per group). Of
   the buckets only those that hold a wanted rank are kept.
4. While a kept bucket has more than ``limit`` distinct values, steps 2 and 3
   are done again inside the kept buckets.
5. Values of the kept buckets are ordered and their rank ranges computed; the
   one covering a rank wins. ``v_lo + frac * (v_hi - v_lo)`` with
   ``pos = (n - 1) * p``.

Values that ``value`` cannot tell apart may be told apart by a ``tie`` column,
which orders them (wide whole numbers beside their doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import materialize

BUCKETS = 256
STEP = 16
#: Distinct values of a bucket that one task may order.
LIMIT = 1_000_000


def histogram(long_df: DataFrame, group_col: str, value_col: str, *tie: str) -> DataFrame:
    """(group, value, tie columns, _w), written down once."""
    return materialize(long_df.where(F.col(value_col).isNotNull()).groupBy(group_col, value_col, *tie)
                       .agg(F.count(F.lit(1)).alias("_w")))


def _cut(values: DataFrame, g: str, v: str, buckets: int) -> DataFrame:
    """``values`` (group, _at, ...) with the bucket ``_b`` of each value."""
    cut_probs = [i / buckets for i in range(1, buckets)]
    cuts = values.groupBy(g, "_at").agg(F.percentile_approx(v, cut_probs, 10 * buckets).alias("_cuts"))
    # every STEP-th cut, and as many lists of the cuts that follow each of them
    coarse = F.filter("_cuts", lambda c, i: i % STEP == STEP - 1)
    fine = F.transform(F.sequence(F.lit(0), F.floor(F.size("_cuts") / STEP).cast("int")),
                       lambda i: F.slice("_cuts", i * STEP + 1, STEP - 1))
    cuts = cuts.select(g, "_at", coarse.alias("_coarse"), fine.alias("_fine"))

    def below(cut_points):
        return F.size(F.filter(cut_points, lambda c: c < F.col(v)))

    found = values.join(F.broadcast(cuts), [g, "_at"]).withColumn("_c", below("_coarse"))
    return found.withColumn("_b", F.col("_c") * STEP + below(F.get("_fine", F.col("_c")))).drop("_coarse", "_fine", "_c")


def histogram_quantiles(hist: DataFrame, group_col: str, value_col: str, probs: list[float], tie: str | None = None,
                        buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """Return ``(group_col, p, q)`` with ``q`` the exact interpolated quantile."""
    g, v = group_col, value_col
    order = [v, tie] if tie else [v]
    values, need, before = hist.withColumn("_at", F.lit("")), None, None
    while True:
        binned = materialize(_cut(values, g, v, buckets))
        totals = binned.groupBy(g, "_at", "_b").agg(F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_values"))
        running = Window.partitionBy(g, "_at").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.withColumn("_end", F.sum("_bw").over(running)).withColumn("_start", F.col("_end") - F.col("_bw"))
        if need is None:
            # group sizes come from the small bucket table, not another pass
            need = (totals.groupBy(g).agg(F.sum("_bw").alias("_n"))
                    .select(g, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
                    .withColumn("_pos", (F.col("_n") - 1) * F.col("p")).withColumn("_frac", F.col("_pos") - F.floor("_pos"))
                    .select(g, "p", "_frac", F.lit("").alias("_at"), F.explode(F.array(
                        F.floor("_pos").cast("bigint"), F.ceil("_pos").cast("bigint"))).alias("_r"), F.lit(0).cast("bigint").alias("_base"))
                    .distinct())
        here = F.col("_r") - F.col("_base")
        inside = F.concat_ws("/", "_at", "_b")
        # a few rows per group and probability
        need = materialize(need.join(totals, [g, "_at"]).where((here >= F.col("_start")) & (here < F.col("_end")))
                           .select(g, "p", "_frac", inside.alias("_at"), "_r", (F.col("_base") + F.col("_start")).alias("_base"), "_values"))
        values = (binned.withColumn("_at", inside).drop("_b")
                  .join(F.broadcast(need.select(g, "_at").distinct()), [g, "_at"], "left_semi"))
        most = need.agg(F.max("_values")).first()[0] or 0
        need = need.drop("_values")
        if most <= limit or most == before:  # equal doubles cannot be cut further
            break
        before = most
    running = Window.partitionBy(g, "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_vend", F.sum("_w").over(running)).withColumn("_vstart", F.col("_vend") - F.col("_w"))
    here = F.col("_r") - F.col("_base")
    hit = (need.join(ranked, [g, "_at"]).where((here >= F.col("_vstart")) & (here < F.col("_vend")))
           .select(g, "p", "_frac", "_r", F.col(v).cast("double").alias("_v")))
    return (hit.groupBy(g, "p")
            .agg(F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"), F.first("_frac").alias("_frac"))
            .select(g, "p", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("q")))


def exact_quantiles(long_df: DataFrame, group_col: str, value_col: str, probs: list[float],
                    buckets: int = BUCKETS, limit: int = LIMIT) -> DataFrame:
    """``histogram_quantiles`` of the values of ``long_df``."""
    return histogram_quantiles(histogram(long_df, group_col, value_col), group_col, value_col, probs, None, buckets, limit)
