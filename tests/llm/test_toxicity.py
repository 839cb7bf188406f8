import random
import zlib

import numpy as np
from helpers import corpus, empty, frame

from furrow.llm import toxicity as tox


def labelled(n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(["sun", "tree", "water", "stone", "light"]) for _ in range(rng.randint(5, 40))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w), "en", "src0", 1))
        labels.append((i, int(bad), "extra"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    model = tox.train(marks.filter(~tox.held_out()), docs)
    scored = tox.score(docs.select("doc_id", "text", tox.held_out().alias("out")), model).collect()
    out = [r for r in scored if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored) and len(out) > 30
    right = sum((r.score >= tox.THRESHOLD) == (r.doc_id % 4 == 0) for r in out)
    assert right >= 0.95 * len(out)


def test_counts_cover_all_labelled_rows(spark):
    rows, labels = labelled(60)
    docs = frame(spark, rows).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    small, _ = tox.train(marks, docs, sample_per_class=5)
    again, _ = tox.train(marks.repartition(2), docs.repartition(2), sample_per_class=5)
    assert np.allclose(small, again, atol=1e-5) and np.count_nonzero(small)


def test_edge_cases(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = tox.score(docs, tox.train(none, docs)).collect()
    assert len(got) == len(corpus()) and all(r.score < 1e-6 for r in got)
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 7), (9999, 0)], "doc_id bigint, toxic int")
    got = tox.score(docs, tox.train(odd, docs)).collect()
    assert all(0.0 <= r.score <= 1.0 for r in got)
    assert tox.score(empty(spark), tox.train(odd, empty(spark))).collect() == []


def test_grams_are_distinct_and_whole():
    g = tox.grams("abc abc abc")
    assert len(g) == len(set(g.tolist()))
    assert len(tox.grams(None)) == len(tox.grams(" \n")) == 0
    long = "z" * 100000 + " tail"
    assert set(tox.grams(" tail").tolist()) & set(tox.grams(long).tolist())
