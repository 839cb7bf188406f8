"""Streaming state grows by slots, not by keys."""

from pyspark.sql import functions as F

from furrow.plans.stream_pack import Feed
from furrow.streaming import ingest as S


def test_first_rows_keep_one_state_value_per_slot(spark):
    rows = [(i, i % 300, f"2024-01-0{1 + i // 400} 0{i % 7}:00:00") for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at string").select(
        "event_id", "user_id", F.col("at").cast("timestamp_ntz").alias("ts"))
    feed = Feed(spark, df, "ts", slices=2)
    out = S.read_published(spark, feed.run(S.insert_ignore_state, ["user_id"], "event_id", "ts", 30 * 86_400, slots=4), df.schema)
    assert sorted(r["event_id"] for r in out.collect()) == list(range(300))
    assert max(s.numRowsTotal for p in feed.progress for s in p.stateOperators) <= 4 * 4
