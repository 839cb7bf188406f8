"""Postings found in a text's own row and written in pieces of their buckets."""

import random

from pyspark.sql import functions as F

from furrow.operators import postings as P


def test_words_of_a_text_with_their_positions(spark):
    rnd = random.Random(7)
    texts = [[rnd.choice("abcdeé") * rnd.randint(1, 2) for _ in range(n)] for n in (0, 1, 2, 50, 400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    for i, words in df.select("i", P._words(F.col("t")).alias("w")).collect():
        assert {w: p for w, p in words} == {w: [j for j, x in enumerate(texts[i]) if x == w] for w in texts[i]}


def test_postings_are_written_in_pieces_of_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "PIECE_ROWS", 20)
    x = P.PostingIndex(spark, str(tmp_path), buckets=2)
    docs = [(i, f"the w{i} v{i % 7} the end") for i in range(60)] + [(0, "the w0 v0 the end"), (None, "the null"), (60, None)]
    x.add(spark.createDataFrame(docs, "doc_id long, text string"))
    files = x.table("postings").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 2
    got = {r["doc_id"]: (r["tf"], r["positions"]) for r in x.read(x.lookup(["the"])).collect()}
    assert got == {None: (1, [0]), 0: (4, [0, 0, 3, 3]), **{i: (2, [0, 3]) for i in range(1, 60)}}
    assert x.lookup(["w0", "w59", "end"]) == {"w0": (1, 1), "w59": (1, 1), "end": (60, 1)}
    assert x.table("documents").count() == 62
    assert x.phrase("the w59").collect()[0]["doc_id"] == 59
