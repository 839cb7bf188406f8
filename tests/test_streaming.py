"""Streaming sinks beyond the registered queries."""

import datetime as dt
import glob

import pytest

from furrow.plans.stream_pack import Feed
from furrow.sources.tables import load
from furrow.streaming import ingest as S

SF = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def test_dedup_within_watermark(spark):
    ev = load(spark, SF, "events")
    feed = Feed(spark, ev, "ts", 3)
    out = S.read_published(spark, feed.run(S.dedup_within_watermark, ["user_id", "event_type"], "ts", "400 days"), ev.schema)
    assert out.count() == ev.select("user_id", "event_type").distinct().count()
    assert out.groupBy("user_id", "event_type").count().where("count > 1").count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    df, root = spark.range(5), str(tmp_path / "sink")
    for _ in range(2):
        S.publish(df, root, 0)
        S.publish(df, root, 1)
    assert S.read_published(spark, root, df.schema).count() == 10
    assert S.read_published(spark, str(tmp_path / "none"), df.schema).count() == 0


@pytest.mark.parametrize("writer,more", [(S.insert_ignore, (["event_id"],)), (S.insert_ignore_state, ("event_id", "ts", 86_400))])
def test_insert_ignore_keeps_null_keys(spark, writer, more):
    rows = [(i, BASE + dt.timedelta(minutes=i), None if i % 4 == 0 else i % 3, float(i)) for i in range(40)]
    feed = Feed(spark, spark.createDataFrame(rows, SCHEMA), "ts", 2)
    out = S.read_published(spark, feed.run(writer, ["user_id"], *more), feed.df.schema)
    got = sorted(((r.user_id, r.event_id) for r in out.collect()), key=str)
    firsts = [(k, min(i for i in range(40) if i % 4 and i % 3 == k)) for k in range(3)]
    assert got == sorted([(None, i) for i in range(0, 40, 4)] + firsts, key=str)


def test_state_ends_with_its_horizon(spark):
    """A new key each minute; the state holds the keys of the last hour."""
    rows = [(i, BASE + dt.timedelta(minutes=i), i, 0.0) for i in range(600)]
    feed = Feed(spark, spark.createDataFrame(rows, SCHEMA), "ts", 5)
    held, run = [], feed.run
    arrivals = feed.arrivals
    for arrival in arrivals:
        feed.arrivals = [arrival]
        out = run(S.insert_ignore_state, ["user_id"], "event_id", "ts", 3600)
        held.append(max(o["numRowsTotal"] for p in feed.progress for o in p["stateOperators"]) if feed.progress else 0)
    assert S.read_published(spark, out, feed.df.schema).count() == 600
    assert held[-1] <= 2 * (120 + 60 + 5) and held[-1] < 600  # keys of a slice and of the hour before, and their timers


def test_a_key_returns_once_the_watermark_has_passed_its_horizon(spark):
    """When hour 30 comes the watermark is still at hour 2, so it is a repeat."""
    rows = [(i, BASE + dt.timedelta(hours=h), 1, 0.0) for i, h in enumerate((0, 1, 2, 30, 31, 80))]
    feed = Feed(spark, spark.createDataFrame(rows, SCHEMA), "ts", 6)
    out = S.read_published(spark, feed.run(S.insert_ignore_state, ["user_id"], "event_id", "ts", 4 * 3600.0), feed.df.schema)
    assert sorted(r.event_id for r in out.collect()) == [0, 5]


def test_live_counts_rewrite_only_the_days_they_change(spark):
    rows = [(i, BASE + dt.timedelta(hours=6 * i), i % 2, 1.0) for i in range(40)]
    feed = Feed(spark, spark.createDataFrame(rows, SCHEMA), "ts", 5)
    from pyspark.sql import functions as F
    seen, arrivals = [], feed.arrivals
    for arrival in arrivals:
        feed.arrivals = [arrival]
        out = feed.run(S.live_counts, "ts", ["user_id"], {"n": F.count(F.lit(1))}, "1 day", None, "2 days")
        seen.append({f.split("/")[-2]: f for f in glob.glob(f"{out.removeprefix('file:')}/*/*.parquet")})
    for old, new in zip(seen, seen[1:]):
        kept = [d for d in old if old[d] == new.get(d)]
        assert len(kept) >= len(old) - 1  # at most the open day is written anew
    got = {(r.day.isoformat(), r.user_id): r.n for r in spark.read.parquet(out).collect()}
    assert got == {(d, u): 2 for d in sorted({(BASE + dt.timedelta(days=k)).date().isoformat() for k in range(10)}) for u in (0, 1)}
