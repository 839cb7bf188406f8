"""Dashboard time series (R5): bucket, aggregate, zero-fill, smooth, compare.

Aggregation happens first (partial aggregation per bucket and series), so
every window below runs over the *aggregated* series, whose size is bounded
by (number of buckets) x (number of series), not by the event count.
The spine of buckets is built per series from the requested (or global)
bounds with ``sequence`` + ``explode`` (no cross join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"hour", "day", "week", "month"}


def bucket(ts: Column, unit: str) -> Column:
    """Calendar bucket start; weeks start on Monday (``date_trunc('week')``).

    Hours of a TIMESTAMP_NTZ are cut by interval arithmetic, never through the
    session zone, whose clock changes would move them; coarser units are DATEs.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    if unit == "hour":
        wall = ts.cast("timestamp_ntz")
        return wall - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(wall), F.date_part(F.lit("SECOND"), wall))
    if unit == "day":
        return F.to_date(ts)
    return F.trunc(F.to_date(ts), unit)


def _step(unit: str) -> Column:
    return F.expr({"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS",
                   "month": "INTERVAL 1 MONTH"}[unit])


def aggregate_series(df: DataFrame, ts: str, unit: str, series: list[str],
                     measures: dict[str, Column]) -> DataFrame:
    return (df.withColumn("bucket", bucket(F.col(ts), unit))
            .groupBy(*series, "bucket").agg(*[c.alias(n) for n, c in measures.items()]))


def fill_gaps(agg: DataFrame, unit: str, series: list[str], fill: dict[str, object],
              lo=None, hi=None) -> DataFrame:
    """Every series gets every bucket from ``lo`` to ``hi`` (default: the
    global first and last bucket, read with one two-value aggregate)."""
    if lo is None or hi is None:
        b = agg.agg(F.min("bucket"), F.max("bucket")).first()
        lo, hi = (lo if lo is not None else b[0]), (hi if hi is not None else b[1])
    typ = agg.schema["bucket"].dataType.simpleString()
    keys = agg.select(*series).distinct()
    spine = keys.select(*series, F.explode(F.sequence(F.lit(lo).cast(typ), F.lit(hi).cast(typ),
                                                      _step(unit))).alias("bucket"))
    # null-safe: rows without a series value are a series of their own
    found = agg.select(*[F.col(c).alias(f"_{c}") if c in [*series, "bucket"] else F.col(c) for c in agg.columns])
    same = F.col("bucket") == F.col("_bucket")
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = spine.join(found, same, "left").drop("_bucket", *[f"_{c}" for c in series])
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def moving_average(series_df: DataFrame, series: list[str], value: str, rows: int,
                   out: str = "moving_avg") -> DataFrame:
    """Trailing mean over the last ``rows`` buckets (including the current)."""
    w = Window.partitionBy(*series).orderBy("bucket").rowsBetween(-(rows - 1), 0)
    return series_df.withColumn(out, F.avg(value).over(w))


def period_over_period(series_df: DataFrame, series: list[str], value: str, unit: str) -> DataFrame:
    """The value one ``unit`` earlier (null when that bucket is absent) and the
    change against it."""
    w = Window.partitionBy(*series).orderBy("bucket")
    due = (F.col("bucket") - _step(unit)).cast(series_df.schema["bucket"].dataType)
    prev = F.when(F.lag("bucket").over(w) == due, F.lag(value).over(w))
    return series_df.withColumn("previous", prev).withColumn("change", F.col(value) - F.col("previous"))
