"""Registered streaming queries (R8): events arrive in four time-ordered slices.

``Feed`` stands in for the outside: it lands a slice in a folder, lets the
query take in what is there (``availableNow``), and lands the next one. So the
micro-batches are the same on every run and results can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import conf_scope, scratch_path
from furrow.sources.tables import load
from furrow.streaming import ingest as S

SLICES = 4


class Feed:
    """A landing folder fed in time-ordered slices; ``late`` slices are landed
    once more at the end."""

    def __init__(self, spark: SparkSession, df: DataFrame, time_col: str, slices: int = SLICES, late: tuple[int, ...] = ()):
        self.spark, self.df = spark, df
        self.landing, self.checkpoint, self.out = (scratch_path(spark, f"stream-{x}") for x in ("landing", "checkpoint", "out"))
        lo, hi = df.agg(F.min(time_col), F.max(time_col)).first()
        cuts = [lo + (hi - lo) * i / slices for i in range(1, slices)] if lo is not None else []
        place = sum(((F.col(time_col) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
        self.arrivals = [df.where(place == i) for i in [*range(slices), *late]]

    def run(self, writer, *args, **options) -> str:
        """Drive ``writer(stream, out, checkpoint, ...)``; returns ``out``."""
        for arrival in self.arrivals:
            arrival.write.mode("append").parquet(self.landing)
            stream = self.spark.readStream.schema(self.df.schema).parquet(self.landing)
            with conf_scope(self.spark, dict([S.STATE_STORE])):
                query = writer(stream, self.out, self.checkpoint, *args, **options).trigger(availableNow=True).start()
                query.awaitTermination()
            if query.exception() is not None:
                raise RuntimeError(str(query.exception()))
            self.progress = query.recentProgress
        return self.out


def _feed(spark: SparkSession, sf: str, **options) -> Feed:
    return Feed(spark, load(spark, sf, "events"), "ts", **options)


def _measures() -> dict:
    return {"events": F.count(F.lit(1)), "value_sum": F.sum("value")}


def stream_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    feed = _feed(spark, sf)
    return S.read_published(spark, feed.run(S.insert_ignore, ["user_id", "event_type"], ["event_id"]), feed.df.schema)


def stream_insert_ignore_state(spark: SparkSession, sf: str) -> DataFrame:
    """Same result as ``stream_insert_ignore``, with the seen keys kept in
    streaming state instead of re-read from the sink each batch."""
    feed = _feed(spark, sf)
    out = feed.run(S.insert_ignore_state, ["user_id", "event_type"], "event_id", "ts", 400 * 86_400)
    return S.read_published(spark, out, feed.df.schema)


def stream_first_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """The first event per user, type and day. A key returns on its own day
    only, so state that ends after a day gives the rows of the batch load."""
    feed = Feed(spark, load(spark, sf, "events").withColumn("day", F.to_date("ts")), "ts")
    out = feed.run(S.insert_ignore_state, ["user_id", "event_type", "day"], "event_id", "ts", 86_400)
    return S.read_published(spark, out, feed.df.schema)


def _by_day(df: DataFrame) -> DataFrame:
    return df.select(F.to_date("window_start").alias("day"), "event_type", F.col("events").cast("bigint").alias("events"),
                     F.round("value_sum", 2).alias("value_sum"))


def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _by_day(spark.read.parquet(_feed(spark, sf).run(S.total_counts, "ts", ["event_type"], _measures())))


def stream_live_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts in update mode: a batch rewrites the days it changed."""
    return _by_day(spark.read.parquet(_feed(spark, sf).run(S.live_counts, "ts", ["event_type"], _measures())))


def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Day-long windows every 12 hours per event type, in update mode."""
    out = _feed(spark, sf).run(S.live_counts, "ts", ["event_type"], _measures(), "1 day", "12 hours")
    return spark.read.parquet(out).select("window_start", "event_type", F.col("events").cast("bigint").alias("events"))


SESSION = "user_id bigint, session_start timestamp_ntz, session_end timestamp_ntz, events bigint"


def _sessions(spark: SparkSession, sf: str, **options) -> DataFrame:
    feed = _feed(spark, sf, **options)
    out = feed.run(S.sessions, "ts", "user_id", "30 minutes", "1 hour")
    return S.read_published(spark, out, spark.createDataFrame([], SESSION).schema)


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf)


def stream_late_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as in ``stream_sessions``, but the first slice is landed a
    second time after the last one; those rows are behind the watermark and
    must be dropped, so the closed sessions are unchanged."""
    return _sessions(spark, sf, late=(0,))


QUERIES = {
    "stream_insert_ignore": stream_insert_ignore,
    "stream_insert_ignore_state": stream_insert_ignore_state,
    "stream_first_of_day": stream_first_of_day,
    "stream_tumbling_counts": stream_tumbling_counts,
    "stream_live_counts": stream_live_counts,
    "stream_sliding_counts": stream_sliding_counts,
    "stream_sessions": stream_sessions,
    "stream_late_drop": stream_late_drop,
}

_COUNTS = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events,
        round(sum(value), 2) AS value_sum FROM events GROUP BY 1, 2"""

ORACLES = {
    "stream_insert_ignore": """SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
    "stream_insert_ignore_state": """SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
    "stream_first_of_day": """SELECT *, CAST(ts AS DATE) AS day FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1""",
    "stream_tumbling_counts": _COUNTS,
    "stream_live_counts": _COUNTS,
    "stream_sliding_counts": """WITH b AS (
          SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events)
        SELECT w AS window_start, event_type, count(*) AS events
        FROM (SELECT event_type, s AS w FROM b UNION ALL SELECT event_type, s - INTERVAL 12 HOUR FROM b)
        GROUP BY 1, 2""",
    "stream_sessions": """WITH e AS (
          SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE
                                   THEN 1 ELSE 0 END AS new_session
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts
                                                         ROWS UNBOUNDED PRECEDING) AS sid FROM e)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
               count(*) AS events
        FROM s GROUP BY user_id, sid
        HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}

ORACLES["stream_late_drop"] = ORACLES["stream_sessions"]
