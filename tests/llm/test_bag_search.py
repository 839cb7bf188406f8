import math
import random
import re
from collections import Counter, defaultdict

from helpers import SCHEMA, corpus, empty, frame

from furrow.llm import bag_search as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, rk int, doc_id string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = defaultdict(list)
    for at, (item, text) in enumerate(items):
        for doc, bag in bags:
            n, score = sum(bag.values()), 0
            for t in set(terms(text)) & set(bag):
                m = 50 + (50 * n * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                out[at, item].append((-score, doc is None, doc or 0))
    return sorted((item, rank, None if no_id else doc, -score) for (_, item), found in out.items()
                  for rank, (score, no_id, doc) in enumerate(sorted(found)[:k], 1))


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)


def found(spark, docs, items, k=B.K, **more):
    got = B.search(frame(spark, docs).repartition(3), asked(spark, items), k, **more).collect()
    return sorted((tuple(r) for r in got), key=str)


def queries(rows, n=12):
    rng = random.Random(5)
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 800]
    out = [(i, " ".join(rng.sample(rng.choice(texts).split() * 3, 3)) + f" W{i:03d}!") for i in range(n)]
    return [*out, (50, ""), (51, None), (52, "nowhere"), (53, "one"), (3, "w001 w002")]


def test_equals_brute_force(spark):
    rows = corpus()
    items = queries(rows)
    for k in (1, 5, 50):
        assert found(spark, rows, items, k) == sorted(brute(rows, items, k), key=str)


def test_groups_of_items_give_the_same(spark):
    rows = corpus()
    items = queries(rows)
    assert found(spark, rows, items, 7, group_terms=10) == sorted(brute(rows, items, 7), key=str)


def test_ties_and_hot_classes(spark):
    """A third of the rows are copies, others tie with them in score."""
    rows = [(1000 - i, "alpha beta", "en", "s", 1) for i in range(200)] + [(i, "beta alpha", "en", "s", 1) for i in range(100)]
    rows += [(2000 + i, f"Alpha other{i}", "en", "s", 1) for i in range(200)] + [(None, "alpha beta", "en", "s", 1)] * 3
    items = [(1, "alpha"), (2, "beta ALPHA"), (3, "other7"), (4, "gamma")]
    assert found(spark, rows, items) == sorted(brute(rows, items, 50), key=str)


def test_small_blocks_prune_alike(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))), "en", "s", 1) for i in range(600)]
    items = [(i, " ".join(rng.sample("abcdefgh", 3))) for i in range(6)]
    monkeypatch.setattr(B, "CELLS", 8)
    best = B.Best(2, 3)
    scores = [[(rng.randint(0, 9), i * 10 + j) for j in range(5)] for i in range(40)]
    import numpy as np
    for block in scores:
        ids = np.array([i for _, i in block])
        best.add(np.array([[s, 9 - s] for s, _ in block], dtype=float), ids, ids)
    best.prune()
    for item in (0, 1):
        every = sorted((-(s if item == 0 else 9 - s), i) for b in scores for s, i in b if (s if item == 0 else 9 - s) > 0)[:3]
        at = best.rows[0] == item
        assert [(-int(s), int(i)) for s, i in zip(best.rows[1][at], best.rows[3][at])] == every
    assert found(spark, rows, items, 20) == sorted(brute(rows, items, 20), key=str)


def test_unicode_terms_and_empty_tables(spark):
    rows = [(1, "Straße ÄÖ 123x_y", "de", "s", 1), (2, "straße äö", "de", "s", 1), (3, "x\x00y z", "de", "s", 1)]
    items = [(1, "STRAßE Äö"), (2, "y 123X"), (3, "y z")]
    assert found(spark, rows, items) == sorted(brute(rows, items, 50), key=str)
    assert found(spark, [], items) == [] and found(spark, rows, []) == []
    assert B.search(empty(spark), spark.createDataFrame([], ITEMS)).collect() == []
    assert spark.createDataFrame([], SCHEMA).count() == 0
