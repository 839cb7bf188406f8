import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import corpus, empty, frame

from furrow.llm import divergence as V

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, top=10):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = shares(total)
        p = {s: shares(counts[lang, s]) for s in sources}
        for a in sources:
            pairs = [(b, sum((p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t]) for t in kept)) for b in sources - {a}]
            terms = [(t, (p[a][t] - q[t]) ** 2 // (p[a][t] + q[t])) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, a, part, item, value, rank) for rank, (item, value) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    return sorted(tuple(r) for r in V.audit(frame(spark, rows).repartition(3), **more).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = corpus()
    for i in range(400):
        pool = [f"{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)] + ["ß", "Äb", "ÄB", "zz"]
        text = " ".join(rng.choice(pool[:20 + i % 44]) for _ in range(rng.randint(0, 30)))
        out.append((1000 + i, text, ["en", "de", "x"][i % 3], f"src{rng.choice([0] * 5 + list(range(9)))}", 0))
    return [*out, (2000, "rare words only", "lone", "src0", 0), (2001, "", "lone", "src1", 0), (2002, None, "bare", None, 0)]


def test_equals_brute_force(spark, rows):
    assert audited(spark, rows) == brute(rows)


def test_small_blocks_and_pair_buffers_give_the_same(spark, rows):
    assert audited(spark, rows, block_terms=7, pair_rows=2) == brute(rows)


def test_other_limits(spark, rows):
    assert audited(spark, rows, min_docs=2, top=3) == brute(rows, 2, 3)


def test_empty_table(spark):
    assert V.audit(empty(spark)).collect() == []


def test_runs_are_sorted_and_add_up(rows):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows]) for i in (2, 3, 1)], names=["lang", "source", "text"])
    runs = [b.to_pylist() for b in V._index(50)([batch])]
    assert len(runs) > 3
    for r in runs:
        keys = [(x["term"], x["lang"], x["source"]) for x in r]
        assert keys == sorted(set(keys))
    assert sum(x["docs"] for r in runs for x in r if x["term"] == b"") == len(rows)


def test_counts_beyond_64_bit_products(spark):
    """Shares of counts whose product with 10^9 passes 64 bits are exact."""
    rows = [(n, 4 * n, 7) for n in (0, 5, 8_999_999_999, 9_000_000_000, 10 ** 13)]
    got = spark.createDataFrame(rows, "n bigint, total bigint, v bigint").withColumn("p", V._share("n", "total")).collect()
    assert [r.p for r in got] == [1 + 10 ** 9 * (n + 2) // (total + 2 * v) for n, total, v in rows]
