"""Range join as an equi-join on fixed-width buckets.

``ts in [start, end)`` has no equality, so Spark would plan a nested-loop
join. Points get the bucket ``floor(x / width)``; each range is exploded into
the buckets it overlaps (``sequence``); the join is then an equi-join on the
bucket (hash-partitioned, AQE-managed) followed by the exact range filter.
Each range produces ``ceil(length / width) + 1`` bucket rows at most, so the
width should be around the typical range length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seconds(c: Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ / TIMESTAMP / numeric column (UTC)."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000)


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str,
               width_seconds: int, how: str = "inner", numeric: bool = False) -> DataFrame:
    """Rows of ``points`` with every range where ``start <= point < end``.

    ``how``: inner, left, left_semi or left_anti. A range lies in several
    buckets, so a join that keeps unmatched ranges would repeat them.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"range_join cannot keep unmatched ranges: how={how!r}")
    conv = (lambda c: c) if numeric else _seconds
    pb = points.withColumn("_bk", F.floor(conv(F.col(point)) / width_seconds).cast("bigint"))
    rb = ranges.withColumn("_bk", F.explode(F.sequence(
        F.floor(conv(F.col(start)) / width_seconds).cast("bigint"),
        F.floor(conv(F.col(end)) / width_seconds).cast("bigint"))))
    cond = (pb["_bk"] == rb["_bk"]) & (pb[point] >= rb[start]) & (pb[point] < rb[end])
    out = pb.join(rb, cond, how).drop(pb["_bk"])
    return out if how in ("left_semi", "left_anti") else out.drop(rb["_bk"])
