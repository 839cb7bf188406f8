"""Heavy hitters (R3, R6): frequent values in bounded space.

Each task keeps a frequent-items summary of at most ``tracked`` values (Spark's
``approx_top_k`` functions); summaries are merged, never values shuffled. With
``tracked`` values held, a count is off by at most ``error_share(tracked)`` of
all rows, and every value that occurs more often than that is in the summary.

``summaries`` are stored and merged by coarser questions (a month's from its
days'). ``top_values`` asks one for its most frequent values. ``exact_top`` uses
one as a filter: it recounts the candidates exactly and says whether a value
outside could have made the list (``certain``); the grouped count of all values
(``profile_topk``) stays the way to an answer without such a condition.

Null values are not counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKED = 10_000


def error_share(tracked: int = TRACKED) -> float:
    """By how large a share of the rows a count may be off: 3.5 over the size of
    the summary's table, the power of two that holds ``tracked`` at 3/4 load."""
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def summaries(df: DataFrame, cols: list[str], by: list[str] = (), tracked: int = TRACKED) -> DataFrame:
    """(by..., column, rows, summary): one summary per group and column."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    return (long.where("value IS NOT NULL").groupBy(*by, "column")
            .agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("summary")))


def merged(found: DataFrame, by: list[str] = (), tracked: int = TRACKED) -> DataFrame:
    """Coarser summaries, from those of finer groups."""
    return found.groupBy(*by, "column").agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))


def top_values(found: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """(by..., column, rows, value, count, rank): the ``k`` most frequent values
    as the summaries have them, ties by value."""
    items = found.select(*by, "column", "rows", F.inline(F.expr(f"approx_top_k_estimate(summary, {k})")))
    rank = F.row_number().over(Window.partitionBy(*by, "column").orderBy(F.desc("count"), "value"))
    return items.select(*by, "column", "rows", F.col("item").alias("value"), "count").withColumn("rank", rank)


def exact_top(df: DataFrame, col: str, k: int, tracked: int = TRACKED, spare: int = 4) -> DataFrame:
    """(value, count, rank, certain): the ``k`` most frequent values of ``col``
    with exact counts. ``spare * k`` candidates are recounted; ``certain`` is
    false where a value that is no candidate might occur as often."""
    found = top_values(summaries(df, [col], tracked=tracked), spare * k).collect()  # spare * k rows
    if not found:
        return df.sparkSession.createDataFrame([], "value string, count bigint, rank int, certain boolean")
    least = found[-1]["count"] if len(found) == spare * k else 0
    beyond = least + error_share(tracked) * found[0]["rows"] if least else 0
    value = F.col(col).cast("string")
    counts = df.where(value.isin([r["value"] for r in found])).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("certain", F.col("count") > F.lit(beyond))
