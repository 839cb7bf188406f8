"""Column profiles (R3): numeric summaries, top-k values, correlations.

Column sets are turned into *long* data ``(column, value)`` first, so every
statistic is a grouped aggregation over ``column`` and the job count does not
grow with the number of columns. Exact distinct counts are the default (they
match an SQL oracle); ``exact=False`` switches to sketches for distinct counts
and quantiles.

Means, deviations and quantiles are doubles. What a double cannot tell apart is
kept beside it: whole numbers and decimals carry their own value too, so
distinct counts, order, ``min_text`` and ``max_text`` are exact at any width.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.quantiles import histogram, histogram_quantiles
from furrow.functions.topk import top_k_per_group

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def to_long(df: DataFrame, cols: list[str], cast: str, table: str | None = None) -> DataFrame:
    """``(table, column, value)`` rows: one per input row and column (narrow)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value"))
                      for c in cols])
    out = df.select(F.inline(pairs))
    return out.select(F.lit(table).alias("table"), "column", "value") if table else out


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _with_own_values(df: DataFrame, cols: list[str], table: str) -> DataFrame:
    """``(table, column, value, own)`` rows: the value as a double, and a whole
    number or decimal as it is (null for floating point)."""
    kinds = {c: df.schema[c].dataType for c in cols}
    decimals = [k for k in kinds.values() if isinstance(k, T.DecimalType)]
    own = "bigint"
    if decimals:  # wide enough for all, with the largest scale
        scale = max(k.scale for k in decimals)
        own = f"decimal({min(38, max([19, *(k.precision - k.scale for k in decimals)]) + scale)},{scale})"
    exact = WHOLE + (T.DecimalType,)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                               (F.col(c) if isinstance(k, exact) else F.lit(None)).cast(own).alias("own")) for c, k in kinds.items()])
    return df.select(F.inline(pairs)).select(F.lit(table).alias("table"), "column", "value", "own")


def _summaries(long: DataFrame, cols: list[str], df: DataFrame, digits: int, *more) -> DataFrame:
    """One aggregation pass: what needs neither distinct values nor their order."""
    scales = {c: df.schema[c].dataType.scale if isinstance(df.schema[c].dataType, T.DecimalType) else 0 for c in cols}

    def text(own):
        out = F.lit(None).cast("string")
        for scale in sorted(set(scales.values())):
            named = [c for c in cols if scales[c] == scale]
            out = F.when(F.col("column").isin(named), own.cast(f"decimal(38,{scale})").cast("string")).otherwise(out)
        return out

    out = long.groupBy("table", "column").agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).cast("bigint").alias("nulls"),
        F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max"),
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_samp("value"), digits).alias("stddev"),
        F.min("own").alias("min_text"), F.max("own").alias("max_text"), *more)
    return out.withColumn("min_text", text(F.col("min_text"))).withColumn("max_text", text(F.col("max_text")))


def _name(p: float) -> str:
    return f"p{int(round(p * 100))}"


def profile_numeric(df: DataFrame, table: str, cols: list[str] | None = None,
                    probs=(0.25, 0.5, 0.95), digits: int = 6, exact: bool = True) -> DataFrame:
    """table, column, count, nulls, distinct, min, max, mean, stddev, p25, p50,
    p95, min_text, max_text."""
    cols, probs = cols or numeric_columns(df), list(probs)
    long = _with_own_values(df, cols, table)
    names = ["table", "column", "count", "nulls", "distinct", "min", "max", "mean", "stddev", *map(_name, probs), "min_text", "max_text"]
    if not exact:  # sketches: one aggregation pass, no histogram
        found = _summaries(long, cols, df, digits, F.percentile_approx("value", probs, 10_000).alias("_q"),
                           F.approx_count_distinct(F.when(F.col("value").isNotNull(), F.struct("value", "own"))).alias("distinct"))
        return found.select("*", *[F.round(F.get("_q", F.lit(i)), digits).alias(_name(p)) for i, p in enumerate(probs)]).select(names)
    hist = histogram(long.withColumn("_g", F.concat_ws("\u0001", "table", "column")), "_g", "value", "own")
    q = histogram_quantiles(hist, "_g", "value", probs, tie="own")
    wide = q.groupBy("_g").pivot("p", probs).agg(F.first("q"))
    wide = wide.select("_g", *[F.round(F.col(f"`{p}`"), digits).alias(_name(p)) for p in probs])
    distinct = hist.groupBy("_g").agg(F.count(F.lit(1)).alias("distinct"))
    return (_summaries(long, cols, df, digits).withColumn("_g", F.concat_ws("\u0001", "table", "column"))
            .join(wide, "_g", "left").join(distinct, "_g", "left").na.fill(0, ["distinct"]).select(names))


def profile_integers(df: DataFrame, table: str, cols: list[str] | None = None) -> DataFrame:
    """Whole-number columns in their own type, never through double: table,
    column, count, nulls, distinct, min, max (exact beyond 2 ** 53)."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    return to_long(df, cols, "bigint", table).groupBy("table", "column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).cast("bigint").alias("nulls"),
        F.count_distinct("value").alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"))


def profile_topk(df: DataFrame, table: str, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """k most frequent values per string column, ties by value:
    table, column, value, count, rank."""
    cols = cols or string_columns(df)
    freq = (to_long(df, cols, "string", table).where(F.col("value").isNotNull())
            .groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("count")))
    return top_k_per_group(freq, ["table", "column"], [F.desc("count"), F.asc("value")], k)


def profile_corr(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Pairwise Pearson correlation (one aggregation pass): col_a, col_b, corr."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                              F.round(F.col(f"c{i}"), digits).alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))
