"""Loads on two unique keys join by sorting."""

import random

from furrow.operators import conflicts as C


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_two_keys_hold_no_broadcast_tables(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(150) if rnd.random() > .05 else None, rnd.randrange(150)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a long, b long")
    held = [(-1, 5, 7), (-2, None, 9)]
    got = C.insert_ignore_any(spark.createDataFrame(held, "i long, a long, b long"), df, [["a"], ["b"]], ["i"], tail=5)
    assert "BroadcastHashJoin" not in plan(got)
    taken_a, taken_b, want = {5}, {7, 9}, []
    for i, a, b in rows:
        if a not in taken_a and b not in taken_b:
            want.append(i)
            taken_a |= {a} - {None}
            taken_b.add(b)
    assert sorted(r["i"] for r in got.collect()) == want
