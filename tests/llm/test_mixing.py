import hashlib
import re
from collections import Counter, defaultdict

import pytest
from helpers import corpus, empty, frame

from furrow.llm import mixing


def targets(sizes, weights=mixing.WEIGHTS, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_follows_targets(spark):
    rows = mixing.mix_plan(frame(spark)).collect()
    assert len(rows) == len(corpus())
    sizes, taken, longest = defaultdict(int), defaultdict(int), 0
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest = max(longest, r.size)
        assert r.taken == r.copies * r.size and r.copies <= 3
    wanted = targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source])
        assert r.source_size == sizes[r.source]
    total = sum(sizes.values())
    assert abs(total - sum(taken.values())) <= longest / 2
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * longest
    # the shares in virtual time: nobody starts a copy after another was cut
    again = {(r.doc_id, r.h): r.taken for r in mixing.mix_plan(frame(spark).repartition(3)).collect()}
    assert again == {(r.doc_id, r.h): r.taken for r in rows}


def test_mix_writes_copies(spark):
    docs = frame(spark)
    plan = mixing.mix_plan(docs).groupBy("doc_id").sum("copies").collect()
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in plan if r[1]}


def test_empty(spark):
    assert mixing.mix_plan(empty(spark)).collect() == []
    assert mixing.mix(empty(spark)).collect() == []


def brute(rows, seed=mixing.SEED):
    """Copies per row by serving the sources one copy at a time."""
    def key(r):
        inner = hashlib.md5((r[1] or "").encode()).hexdigest()
        return int(hashlib.md5(f"{seed}|{'' if r[0] is None else r[0]}|{inner}".encode()).hexdigest()[:15], 16)

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(rows)}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (key(rows[i]), rows[i][0])) for s in sources}
    total = {s: sum(size[i] for i in own[s]) for s in sources}
    wanted, queue = targets(total), []
    for rank, s in enumerate(sources):
        done = 0
        for epoch in range(mixing.MAX_EPOCHS):
            for pos, i in enumerate(own[s]):
                done += size[i]
                if size[i]:
                    queue.append((done / wanted[s], rank, pos, epoch, i))
    budget, spent, copies = sum(total.values()), 0, Counter()
    for *_, i in sorted(queue):
        if spent + size[i] > budget:
            copies[i] += spent + size[i] - budget < budget - spent
            break
        spent += size[i]
        copies[i] += 1
    return sorted((key(rows[i]), copies[i] * size[i]) for i in size)


def test_taken_equals_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = sorted((r.h, r.taken) for r in mixing.mix_plan(frame(spark, rows).repartition(5)).collect())
    assert got == brute(rows)


def test_the_crossing_copy_is_taken_where_that_is_nearer(spark):
    def taken(sizes):
        rows = [(i, " ".join(["w"] * n), "en", s, 0) for i, (s, n) in enumerate(sizes)]
        return sum(r.taken for r in mixing.mix_plan(frame(spark, rows)).collect()), brute(rows)

    found, want = taken([("a", 50), ("b", 10)])
    assert found == sum(t for _, t in want) == 60
    for sizes in ([("a", 3), ("a", 8), ("b", 4)], [("a", 1)], [("a", 100), ("b", 1), ("c", 1)]):
        found, want = taken(sizes)
        assert found == sum(t for _, t in want)
