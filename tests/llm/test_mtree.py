import pickle
import random

import numpy as np

from furrow.llm import mtree

SCHEMA = "vec_id bigint, embedding array<float>, label int, tree string, v int"


def brute(ids, vectors, q, own, k):
    scores = vectors @ q
    rows = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != own)
    return [(-s, i) for s, i in rows[:k]]


def test_search_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, page, spread in ((1, 4, 9), (7, 3, 2), (200, 5, 3), (300, 4, 1), (500, 16, 40)):
        vectors = rng.integers(-spread, spread + 1, size=(n, 6)).astype(np.int64)
        vectors[: n // 3] = vectors[0]  # a third of all rows is one vector
        ids = rng.permutation(n * 2)[:n].astype(np.int64)
        tree = mtree.MTree(ids, vectors, page)
        for i in range(0, n, 7):
            want = brute(ids, vectors, vectors[i], ids[i], 5)
            assert tree.search(vectors[i], int(ids[i]), 5) == want
            if len(want) == 5:
                floor = want[2]
                assert tree.search(vectors[i], int(ids[i]), 5, floor) == want[:2]


def test_covering_radii_and_parent_distances():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-30, 30, size=(400, 5)).astype(np.int64)
    tree = mtree.MTree(np.arange(400), vectors, 8)

    def below(page):
        out = []
        for e in range(tree.first[page], tree.first[page + 1]):
            if tree.child[e] < 0:
                out.append(int(tree.object[e]))
            else:
                inside = below(int(tree.child[e]))
                d = np.linalg.norm(tree.points[inside] - tree.points[tree.object[e]], axis=1)
                assert d.max() <= tree.radius[e] + 1e-9 and min(inside) == tree.least[e]
                out += inside
        return out

    assert sorted(below(0)) == list(range(400))


def test_avoids_most_of_a_clustered_set():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 400
    vectors = np.concatenate([c + rng.normal(size=(100, 8)) for c in centres]).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), vectors, 32)
    seen, points = [], tree.points

    class Counting(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(points)[at]
            if out.ndim == 2:
                seen.append(len(out))
            return out

    tree.points = points.view(Counting)
    for i in range(0, 4000, 200):
        assert tree.search(vectors[i], i, 5) == brute(np.arange(4000), vectors, vectors[i], i, 5)
    assert sum(seen) / 20 < 4000 / 2


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 60)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0, "t", 1) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0, "t", 1) for i in range(120)]
    rows += [(500, None, 0, "t", 1), (550, [1.0, None], 0, "t", 1), (600, [float("nan")] * 5, 0, "t", 1),
             (650, [float("inf")] * 5, 0, "t", 1), (None, rows[1][1], 0, "t", 1), (700, [0.5, 0.5], 0, "t", 1), (50, rows[50][1], 0, "t", 1)]
    got = mtree.top_products(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0).collect()
    keep = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    m = np.zeros((len(keep), 5), dtype=np.int64)
    for j, (_, v) in enumerate(keep):
        m[j, :len(v)] = v
    ids = np.array([i for i, _ in keep])
    want = {(int(i), r + 1, v, s) for j, (i, _) in enumerate(keep) if i % 50 == 0
            for r, (s, v) in enumerate(brute(ids, m, m[j], i, 5))}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "t", 1), (3, [2.0], 0, "t", 1)], SCHEMA)
    assert [tuple(r) for r in mtree.top_products(df, lambda i: i % 50 == 0).collect()] == [(0, 1, 3, 256 * 512)]
    assert mtree.top_products(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).collect() == []


def test_many_queries_at_once_equal_brute_force():
    rng = np.random.default_rng(8)
    for n, page, spread, k in ((1, 4, 9, 5), (300, 5, 3, 5), (400, 16, 1 << 20, 3), (400, 16, 1 << 29, 5), (500, 4, 40, 1), (300, 8, 0, 5)):
        vectors = rng.integers(-spread, spread + 1, size=(n, 6)).astype(np.int64)
        vectors[: n // 3] = vectors[0]
        ids = rng.integers(0, n, n).astype(np.int64)  # some come twice
        half = rng.random(n) < 0.5
        best = mtree.Best(n, k)
        for part in (half, ~half):  # floors go from one tree to the next
            tree = pickle.loads(pickle.dumps(mtree.MTree(ids[part], vectors[part], page)))
            tree.search_all(vectors, ids, best)
        for i in range(n):
            on = best.kind[i] == 2
            assert list(zip(best.scores[i, on].tolist(), best.ids[i, on].tolist())) == brute(ids, vectors, vectors[i], ids[i], k)


def test_a_stored_tree_is_little_more_than_its_vectors():
    rng = np.random.default_rng(9)
    tree = mtree.MTree(np.arange(2000), rng.integers(-90, 90, size=(2000, 64)).astype(np.int16))
    assert len(pickle.dumps(tree)) < 2 * 2000 * 64 * 2  # before: six times as much


def shuffled(df):
    """Bytes that the exchanges of an executed frame were given."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [
            node.children().apply(i) for i in range(node.children().size())]
    return total


def test_queries_are_copied_once_a_group_of_trees(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 10)
    monkeypatch.setattr(mtree, "GROUPS", 2, raising=False)
    monkeypatch.setattr(mtree, "QUERY_BYTES", 100 * 152, raising=False)  # several chunks
    rng = np.random.default_rng(10)
    m = rng.integers(-200, 200, size=(600, 16))
    rows = [(i, [float(x) / 256 for x in m[i]], 0, "t", 1) for i in range(600)]
    got = mtree.top_products(spark.createDataFrame(rows, SCHEMA), lambda i: i % 2 == 0)
    want = {(i, r + 1, v, s) for i in range(0, 600, 2) for r, (s, v) in enumerate(brute(np.arange(600), m, m[i], i, 5))}
    out = got.collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == want and len(out) == len(want)
    assert shuffled(got) < 1_500_000  # before: every query to each of about a hundred trees
