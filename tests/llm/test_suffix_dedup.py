import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import corpus, empty, frame

from furrow.llm import suffix_dedup as sd


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone) if not g)))
    return out


def test_suffix_array_in_two_stages():
    rng = random.Random(1)
    for alphabet in (b"a", b"ab", b"abc\x00\xff", bytes(range(97, 123))):
        for n in (1, 2, 3, 10, 200, 700):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            t = np.frombuffer(data, dtype=np.uint8)
            small = sd.suffix_types(t)
            assert [bool(x) for x in small] == [data[i:] < data[i + 1:] for i in range(n)]
            if n < 120:  # deeper than the text: the whole order
                assert sd.suffix_array(t, n + 8).tolist() == sorted(range(n), key=lambda i: data[i:])
            order = sd.suffix_array(t, 16)
            assert sorted(order.tolist()) == list(range(n))
            cut = [data[i:i + 16] for i in order]
            assert cut == sorted(cut)


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(20):
        window = rng.choice([8, 11, 20])
        pool = [bytes(rng.choice(b"ab") for _ in range(window)) for _ in range(4)]
        spans, counts = [], []
        for _ in range(12):
            s = bytes(rng.choice(b"abc") for _ in range(rng.randrange(6))) + rng.choice(pool) + bytes(
                rng.choice(b"abc") for _ in range(rng.randrange(6)))
            spans.append(s)
            counts.append(len(s) - window + 1)
        seen = Counter(s[i:i + window] for s, c in zip(spans, counts) for i in range(c))
        want = [[i for i in range(c) if seen[s[i:i + window]] > 1] for s, c in zip(spans, counts)]
        assert [x.tolist() for x in sd.repeated_starts(spans, counts, window)] == want


def texts_with_repeats(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passages = [prose(rng.randint(20, 60)) for _ in range(5)]
    texts = [prose(rng.randrange(80)) + rng.choice(passages) + prose(rng.randrange(30)) + rng.choice(passages)[:25] + prose(rng.randrange(9))
             for _ in range(40)]
    return [*texts, "z" * 300, "yz" * 70, texts[0], texts[1] + "!", "", None, prose(3000), passages[0] * 9]


def test_removal_equals_brute_force(spark):
    for seed, batch in ((3, sd.BATCH_BYTES), (4, 200)):
        texts = texts_with_repeats(seed)
        docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).repartition(3)
        got = sd.remove_repeats(docs, window=24, gram=8, batch_bytes=batch).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute(texts, 24)


def test_edge_rows(spark):
    rows = corpus()
    got = sd.remove_repeats(frame(spark), window=40, gram=10).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
    assert found == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 40)))
    assert sd.remove_repeats(empty(spark)).collect() == []


def test_spans_stream_over_batches():
    rng = random.Random(5)
    rows = sorted((rng.randrange(5), rng.randrange(3), rng.randrange(4), rng.randrange(3)) for _ in range(60))
    distinct = sorted(set(rows))
    spans = Counter(r[:2] for r in distinct)
    equal = sorted(r for r in distinct if spans[r[:2]] > 1)
    several = {h for h in range(5) if len({s for hh, s in spans if hh == h}) > 1}
    lead = sorted(min(r for r in distinct if r[:2] == s) for s in spans if s[0] in several)
    past = [(7, 1, 1, 1), (7, 1, 2, 2), (8, 0, 3, 3)]  # known to be repeated: they come last and go through
    every = [(*r, False) for r in rows] + [(*r, True) for r in past]
    for size in (1, 2, 9, 60, 63):
        batches = [pa.RecordBatch.from_arrays(
            [*(pa.array([r[c] for r in every[i:i + size]], pa.int64()) for c in range(4)), pa.array([r[4] for r in every[i:i + size]])],
            names=["h", "span", "node", "packed", "past"]) for i in range(0, len(every), size)]
        got = [tuple(x.values()) for b in sd._compare_spans(batches) for x in b.to_pylist()]
        assert sorted(r[1:] for r in got if r[0] == 0) == sorted((h, n, p) for h, _, n, p in equal + past)
        assert sorted(r[1:] for r in got if r[0] == 1) == sorted((h, n, p) for h, _, n, p in lead)


def test_a_span_is_sent_twice_before_it_goes_past():
    rng = np.random.default_rng(1)
    hashes, spans = rng.integers(-2 ** 62, 2 ** 62, 5), rng.integers(-2 ** 62, 2 ** 62, 4)
    for slots in (1, 4, 1 << 16):
        twice, sent = sd.SentTwice(slots), {}
        for _ in range(300):
            h, span = rng.choice(hashes, 7), rng.choice(spans, 7)
            flags = list(zip(zip(h.tolist(), span.tolist()), twice.add(h, span).tolist()))
            assert all(sent.get(pair, 0) >= 2 for pair, past in flags if past)
            for pair, past in flags:
                sent[pair] = sent.get(pair, 0) + (not past)
        if slots > 4:
            assert all(twice.add(h, span)) and max(sent.values()) < 15


def test_a_hot_line_in_few_tasks_of_many(spark):
    """One line in every text, once or many times, in one partition and in many."""
    line = "".join(f"<{i:04d}>" for i in range(60))
    rows = [(i, f"start {i} " * (i % 5) + line * (1 + i % 3) + f" end {i * 7}" * 9, "en", "s", 0) for i in range(60)]
    want = None
    for parts in (1, 7, 40):
        got = sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in
                     sd.remove_repeats(frame(spark, rows).repartition(parts)).collect())
        want = want or got
        assert got == want
    assert all(line.encode() not in k for *_, k in want)
