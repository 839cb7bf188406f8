import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from helpers import corpus, empty, frame, words

from furrow.llm import ngram_join as nj


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if same and den * same >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return out


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits if w else 0):
        if not w:
            break
        at = rng.randrange(len(w))
        w[at:at + 1] = rng.choice([[], [f"n{rng.randrange(99)}"], [w[at], "Add"]])
    return " ".join(w)


def near_corpus(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = words(rng, rng.choice([1, 3, 5, 8, 12, 20, 40, 90, 200]), 80)
        for _ in range(rng.choice([1, 2, 4, 9])):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 1, 1, 2, 4])) if base else "", None, None, 0))
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_components_equal_brute_force(spark):
    for seed, k, num, den in ((1, 4, 85, 100), (3, 2, 1, 2)):
        rows = near_corpus(seed) + [(1000 + (r[0] or 0), *r[1:]) for r in corpus(seed) if r[0] is not None]
        got = nj.jaccard_components(frame(spark, rows), k, num, den).select("doc_id", "n", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, k, num, den))


def test_nulls_and_repeats(spark):
    rows = corpus()
    got = nj.jaccard_components(frame(spark), 4, 85, 100).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 4, 85, 100), key=key)
    assert nj.jaccard_components(empty(spark)).collect() == []


def test_every_linked_pair_shares_a_block():
    rng = random.Random(7)
    shingler = nj.Shingler(3)
    for num, den in ((17, 20), (4, 5)):
        linked = 0
        for _ in range(400):
            base = words(rng, rng.randint(3, 150), 30 if rng.random() < 0.3 else 5000)
            a, b = (shingler.set_of(edited(rng, base, rng.randint(0, 4))) for _ in range(2))
            same = len(np.intersect1d(a, b))
            if len(a) and den * same >= num * (len(a) + len(b) - same) and not np.array_equal(a, b):
                linked += 1
                assert len(np.intersect1d(nj.block_keys(a, num, den), nj.block_keys(b, num, den)))
        assert linked > 30


def test_tree_gives_all_pairs_above_the_bound():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 4, size=(700, nj.COORDS)).astype(np.int64)
    counts[300:] = counts[rng.integers(0, 300, size=400)]
    counts[400:500, :3] += 1
    sizes = counts.sum(axis=1)
    tree = nj.RTree(sizes, counts, 17, 20)
    got = {(int(a), int(b)) for q, p, _ in tree.search(sizes, counts) for a, b in zip(q, p)}
    overlap = np.minimum(counts[:, None], counts[None]).sum(axis=2)
    a, b = np.nonzero(overlap >= nj.needed(sizes[:, None], sizes[None], 17, 20))
    assert got >= set(zip(a.tolist(), b.tolist())) - {(x, y) for x, y in zip(a.tolist(), b.tolist())
                                                     if 17 * max(sizes[x], sizes[y]) > 20 * min(sizes[x], sizes[y])}
    assert len(tree.levels) > 1


def test_blocks_stream_over_batches():
    rng = random.Random(9)
    rows = sorted((rng.randrange(6), rng.randrange(5)) for _ in range(60))
    want = []
    for k in sorted({k for k, _ in rows}):
        nodes = sorted({n for kk, n in rows if kk == k})
        want += [(k, n, nodes[0]) for n in nodes] if len(nodes) > 1 else []
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i:i + size]], pa.int64()),
                                               pa.array([r[1] for r in rows[i:i + size]], pa.int64())], names=["key", "node"])
                   for i in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in nj._shared_blocks(batches) for x in b.to_pylist()]
        assert sorted(got) == want


def test_deduplicate(spark):
    docs = frame(spark)
    out = nj.deduplicate(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    parts = brute(corpus(), 5, 4, 5)
    wanted = sorted([r[2] for r in {(p[2],): p for p in parts if p[1] and p[2] is not None}.values()])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and shingles(r.text, 5)) == wanted
    assert sum(not shingles(r.text, 5) for r in kept) == sum(not p[1] for p in parts)
    assert sum(r.doc_id is None for r in kept) == 1
    assert nj.deduplicate(empty(spark)).collect() == []


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 3)
    monkeypatch.setattr(nj, "HUB_SPLIT", 2)
    rows = near_corpus(11, 6)
    got = nj.jaccard_components(frame(spark, rows), 4, 17, 20).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 17, 20))
