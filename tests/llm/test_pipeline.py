import hashlib
import os

import numpy as np
from helpers import frame
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from furrow.llm import bpe, pii, registry
from furrow.llm.common import staged

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = registry.queries()
    for n in range(1, 14):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert set(entry.queries()) >= set(names) and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "private_data", "mix_sources", "bpe"]


def test_stages_over_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = os.path.join(tmp_path, name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        texts.append(docs)
    toxic, near, private, mixed, encoded = texts
    assert 0 < near.count() <= toxic.count() <= 200
    assert near.count() == near.select("doc_id").distinct().count()
    assert private.count() == near.count()
    assert not [r for r in private.filter(private.text.rlike(pii.EMAIL)).join(
        near.withColumnRenamed("text", "old"), "doc_id").collect() if r.text == r.old]
    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mixed.collect())
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()) == want
    assert all(r.decoded_sha256 for r in encoded.collect())
    assert {r.decoded_sha256 for r in encoded.collect()} == {
        hashlib.sha256(r.text.encode()).hexdigest() for r in mixed.collect()}


def test_stages_on_an_empty_table(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.collect() == []
        if name != "bpe":
            assert set(out.columns) == set(docs.columns)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    docs, kept = frame(spark), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "bpe":
            assert out.count() == kept
        else:
            assert set(out.columns) == set(docs.columns)
            docs = staged(out.select(docs.columns), "test-stage")
            kept = docs.count()
            assert kept and docs.filter("text IS NULL").count() == 1
            assert name == "mix_sources" or docs.filter("doc_id IS NULL").count() == 1
