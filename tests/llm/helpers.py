"""Small frames that hold the awkward cases."""

import random

LANGS = ["en", "de", None]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):03d}" for _ in range(n))


def corpus(seed=3, n=40):
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, a
    shared passage, empty and null texts, a null id, a repeated row, a long text."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = words(rng, 60)
    texts += [texts[0], texts[0], texts[1] + " more", f"{words(rng, 30)} {passage} {words(rng, 30)}",
              f"{passage} {words(rng, 50)}", "", None, " \t\n", "one", "x" * 900, words(rng, 4000)]
    base = words(rng, 150).split()
    for i in range(6):
        copy = list(base)
        copy[rng.randrange(150)] = f"edit{i}"
        texts.append(" ".join(copy))
    rows = [(i, t, LANGS[i % 3], f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "a row without id", "en", "src0", 16), rows[3]]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows=None):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1 AS rk", "'x' AS node", "2 AS size", "'y' AS h", "3 AS score", "4 AS _n", "5 AS block")


def empty(spark):
    return frame(spark, [])
