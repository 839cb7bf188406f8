import hashlib
import random

import numpy as np
from helpers import corpus, empty, frame

from furrow.llm import fingerprints as fp


def brute(text, k, w):
    """Hash of every k-gram, the rightmost smallest of every window."""
    k = min(k, len(text))
    if not k:
        return []
    h = [int(fp.gram_hashes(fp.code_points(text[i:i + k]), k)[0]) for i in range(len(text) - k + 1)]
    w = min(w, len(h))
    kept = set()
    for i in range(len(h) - w + 1):
        low = min(h[i:i + w])
        kept.add((max(j for j in range(i, i + w) if h[j] == low)))
    return [(h[p], p) for p in sorted(kept)]


def test_winnow_equals_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 3, 5, 6, 20, 57, 300):
        for alphabet in ("a", "ab", "abcdefghij é😀"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            h, p = fp.winnow(fp.code_points(text), 5, 4)
            assert list(zip(h.tolist(), p.tolist())) == brute(text, 5, 4)


def test_match_guarantee():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(fp.GRAM + fp.WINDOW - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) for _ in range(2))
        x = fp.winnow(fp.code_points(a + shared + b))[0]
        y = fp.winnow(fp.code_points(b + shared + a))[0]
        assert len(np.intersect1d(x, y))


def test_neighbours(spark):
    rows = sorted(((r[0], r[1] or "") for r in corpus() if r[0] is not None), key=lambda r: -r[0])
    docs = frame(spark, [r for r in corpus()[:-1] if r[0] is not None])
    rows = list(dict.fromkeys(rows))
    got = {r.doc_id: r for r in fp.neighbour_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.encode(*fp.winnow(fp.code_points(text)))
        assert r.edited_fingerprint == fp.encode(*fp.winnow(fp.code_points(edited)))
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1.0) >= (text == follow)


def test_edge_rows(spark):
    assert fp.neighbour_fingerprints(empty(spark)).collect() == []
    assert len(fp.neighbour_fingerprints(frame(spark)).collect()) == len(corpus())
    only = fp.neighbour_fingerprints(frame(spark, [(5, "alone", None, None, 5)])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in only] == [(5, 5, 1.0)]
    out = fp.fingerprint_texts(frame(spark))
    assert out.count() == len(corpus()) and "score" in out.columns


def test_half_kept_short_texts_are_alike():
    rng = random.Random(4)
    for n in range(30, 121):
        text, other = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for _ in range(2))
        edited = fp.edited_with_next(text, other)
        assert fp.likeness(fp.winnow(fp.code_points(text))[0], fp.winnow(fp.code_points(edited))[0]) > 0
