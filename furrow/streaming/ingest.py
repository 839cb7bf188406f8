"""Streaming ingest (R8): the generate -> insert batch loop as Structured Streaming.

Each function takes a streaming DataFrame and returns a ``DataStreamWriter``;
the caller gives it a trigger and starts it. Sinks may be handed a micro-batch
again after a failure and then end in the same state:

* ``insert_ignore`` (``foreachBatch``): first-seen rows per key that the sink
  does not hold. Exact for unbounded history; a batch costs as much as reading
  the keys written so far.
* ``insert_ignore_state`` (``transformWithState``): the same with the keys held
  in RocksDB state, in slots of many keys, of which a batch reads those that it
  has rows for. A timer ends a key's
  state once the watermark is ``horizon`` past its first row, which bounds the
  state: it holds the keys that began within the horizon. The result is that of the batch load
  wherever a key does not return after the horizon.
* ``live_counts``: windowed counts in ``update`` mode. A batch hands over the
  windows that it changed, and only the days of these are rewritten.
* ``total_counts``: windowed counts in ``complete`` mode, without a watermark.
* ``sessions``: ``session_window`` with a watermark in ``append`` mode; only
  closed sessions (end <= watermark) are emitted.

Event-time columns are TIMESTAMP_NTZ in the data. Watermarks need TIMESTAMP:
wall-clock times are taken as if they were UTC, whatever the session's zone, so
that days start at midnight and no clock change moves a window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from furrow.operators import conflicts
from furrow.operators.incremental import merge_partitions, write_partitions
from furrow.session import path_exists

#: ``insert_ignore_state`` needs this state store (set it on the session).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def instant(wall: Column) -> Column:
    """A wall-clock time as the instant at which UTC clocks show it."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall.cast("timestamp_ntz")).cast("timestamp")


def wall_clock(at: Column) -> Column:
    """What UTC clocks show at an instant, as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def publish(df: DataFrame, root: str, batch_id: int) -> None:
    """Write a micro-batch's rows as partition ``batch=<id>`` of ``root``; a
    batch that comes again replaces what it wrote before."""
    write_partitions(df.withColumn("batch", F.lit(batch_id)), root, ["batch"])


def read_published(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows of all batches."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(root).drop("batch")


def _appended(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, i: publish(batch, out, i)))


def insert_ignore(stream: DataFrame, out: str, checkpoint: str, keys: list[str], order_cols: list[str]) -> DataStreamWriter:
    """``stream``'s rows by first-seen key into ``out``."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        # what an earlier try of this batch wrote does not count as taken
        earlier = spark.read.parquet(out).where(F.col("batch") < batch_id) if path_exists(spark, out) else None
        existing = earlier.select(*schema.names) if earlier is not None else None
        publish(conflicts.insert_ignore(existing, batch, keys, order_cols), out, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _comparable(value):
    """``value`` as a part of a dictionary key: equal where Spark groups."""
    if isinstance(value, (list, tuple)):
        return tuple(_comparable(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return "NaN" if value != value else value


class FirstRows(StatefulProcessor):
    """Emits each key's first row and forgets the key ``horizon`` seconds later.

    Spark groups by slot, a share of the keys. A slot's state is one value, the
    time at which each of its keys ends, with one timer at the first of these:
    state is asked once per slot and batch, not several times per key.
    """

    def __init__(self, keys: list[str], order_col: str, time_col: str, horizon: float):
        self.keys, self.order_col, self.time_col, self.horizon = keys, order_col, time_col, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("ends", BinaryType())]))

    def _load(self) -> tuple[int | None, dict]:
        """The slot's timer and, per key, when it ends."""
        return pickle.loads(self.seen.get()[0]) if self.seen.exists() else (None, {})

    def _store(self, timer: int | None, ends: dict) -> None:
        first = min(ends.values())
        if timer is None or first < timer:
            timer = first
            self.handle.registerTimer(timer)
        self.seen.update((pickle.dumps((timer, ends)),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, ends = self._load()
        first: dict = {}
        for r in rows:
            k = tuple([_comparable(r[c]) for c in self.keys])
            if k not in ends and (k not in first or r[self.order_col] < first[k][self.order_col]):
                first[k] = r
        if not first:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        for k, r in first.items():
            # never before the watermark, where a timer would be refused
            ends[k] = max(int(r[self.time_col].timestamp() * 1000), watermark) + int(self.horizon * 1000)
        self._store(timer, ends)
        yield from first.values()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, ends = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        left = {k: end for k, end in ends.items() if end >= watermark}
        if left:
            self._store(None, left)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Slots of the keys in state; a checkpoint keeps the number it began with.
SLOTS = 1024


def insert_ignore_state(stream: DataFrame, out: str, checkpoint: str, keys: list[str], order_col: str, ts: str,
                        horizon_seconds: float, delay: str = "0 seconds", slots: int = SLOTS) -> DataStreamWriter:
    """As ``insert_ignore``, with the keys of the last ``horizon_seconds`` (of
    event time ``ts``) in state. Rows with a null in the key bypass the state."""
    present = conflicts.all_present(keys)
    timed = (stream.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
             .withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(slots))))
    first = timed.where(present).groupBy("_slot").transformWithState(
        FirstRows(keys, order_col, "_ts", horizon_seconds), timed.schema, "Append", "EventTime")
    return _appended(first.unionByName(timed.where(~present)).drop("_ts", "_slot"), out, checkpoint)


def _windows(stream: DataFrame, at: Column, keys: list[str], width: str, slide: str | None, measures: dict[str, Column]) -> DataFrame:
    win = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.groupBy(win.alias("w"), *keys).agg(*[c.alias(n) for n, c in measures.items()])


def live_counts(stream: DataFrame, out: str, checkpoint: str, ts: str, keys: list[str], measures: dict[str, Column],
                width: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataStreamWriter:
    """``out``: (day, window_start, keys, measures), partitioned by day."""
    timed = stream.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
    changed = _windows(timed, F.col("_ts"), keys, width, slide, measures)

    def merge(batch: DataFrame, batch_id: int) -> None:
        start = wall_clock(F.col("w.start")).alias("window_start")
        rows = batch.select(start, *keys, *measures).withColumn("day", F.to_date("window_start"))
        merge_partitions(out, rows, ["window_start", *keys], ["day"])

    return changed.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def total_counts(stream: DataFrame, out: str, checkpoint: str, ts: str, keys: list[str], measures: dict[str, Column],
                 width: str = "1 day", slide: str | None = None) -> DataStreamWriter:
    """All windows again with each batch (``complete`` mode): no window ever
    closes, and none is dropped for being late. ``out`` holds the last state."""
    every = _windows(stream, F.col(ts), keys, width, slide, measures)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, *measures).write.mode("overwrite").parquet(out)

    return every.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)


def sessions(stream: DataFrame, out: str, checkpoint: str, ts: str, user: str, gap: str = "30 minutes",
             delay: str = "1 hour") -> DataStreamWriter:
    """``out``: (user, session_start, session_end, events) of closed sessions."""
    found = (stream.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
             .groupBy(F.session_window("_ts", gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events")))
    return _appended(found.select(user, wall_clock(F.col("s.start")).alias("session_start"),
                                  wall_clock(F.col("s.end")).alias("session_end"), "events"), out, checkpoint)


def dedup_within_watermark(stream: DataFrame, out: str, checkpoint: str, keys: list[str], ts: str, delay: str) -> DataStreamWriter:
    """Drop repeats of a key that arrive within ``delay`` of its first
    occurrence (``dropDuplicatesWithinWatermark``): bounded state, exact only
    within the delay, and any row of a batch may stand for its key."""
    timed = stream.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
    return _appended(timed.dropDuplicatesWithinWatermark(keys).drop("_ts"), out, checkpoint)
