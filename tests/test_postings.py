"""The stored inverted index against scans of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import search as S
from furrow.operators.postings import PostingIndex
from furrow.session import conf_scope

WORDS = ["alpha", "beta", "gamma", "delta", "Straße", "x1", "of", "the"]


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1, 1, 2, 3, 1, 1, 20, 20], k=rng.randint(0, 30)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "The THE, the-the"), (n + 3, "\t of\nthe ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    x = PostingIndex(spark, str(tmp_path_factory.mktemp("postings")), buckets=8, slice_docs=40)
    x.add(docs.where("doc_id < 150"))
    x.add(docs.where("doc_id >= 150"))
    return x


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scores_equal_a_scan(docs, index):
    for terms in (["the"], ["alpha", "of"], ["strasse", "straße", "X1"], ["nowhere"], ["the", "THE", "gamma"]):
        assert index.bm25(terms, 15).collect() == S.bm25(docs.na.fill(""), terms, 15).collect()


def test_boolean_match_equals_a_scan(docs, index):
    for must, must_not, should in ((["the"], ["alpha"], []), ([], ["the"], []), ([], [], ["x1", "alpha"]), (["nowhere"], [], []),
                                   (["of", "gamma"], ["nowhere", "beta"], ["delta", "x1"]), ([], [], [])):
        want = S.boolean_match(docs.na.fill(""), must, must_not, should).select("doc_id")
        assert rows(index.match(must, must_not, should)) == rows(want)


def test_phrases_equal_a_scan(docs, index):
    split = [(r.doc_id, r.t) for r in docs.select("doc_id", S.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    for phrase in ("of the", "The the the", "alpha beta", "gamma", "nowhere the", "", "delta of the of"):
        words = phrase.lower().split()
        want = [(d, [i for i in range(len(t)) if words and t[i:i + len(words)] == words]) for d, t in split]
        assert sorted((d, sorted(at)) for d, at in rows(index.phrase(phrase))) == sorted((d, at) for d, at in want if at)


def test_common_words_are_spread_and_queries_read_few_buckets(spark, index):
    known = index.lookup(["the", "alpha", "nowhere"])
    assert known["the"][1] > 2 and "nowhere" not in known
    spread = index.table("postings").where("term = 'the'").groupBy("cell").count().collect()
    assert len(spread) == known["the"][1] and max(r["count"] for r in spread) < 80

    def scan(terms):
        with conf_scope(spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):  # only this prints it
            plan = index.read(index.lookup(terms))._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return plan[plan.index("SelectedBucketsCount"):].split("\n")[0]

    assert scan(["nowhere", "gamma"]) == "SelectedBucketsCount: 2 out of 8" and index.lookup(["gamma"])["gamma"][1] == 2
    files = {r[0] for r in index.read(index.lookup(["x1"])).select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(files) <= 2 * index.lookup(["x1"])["x1"][1]  # of two loads of eight buckets


def test_a_later_session_reads_the_same_index(spark, docs, tmp_path):
    one = PostingIndex(spark, str(tmp_path), buckets=4)
    one.add(docs.where("doc_id < 20"))
    for name in one.names.values():
        spark.sql(f"DROP TABLE {name}")  # as in a session whose catalog kept no names
    two = PostingIndex(spark, str(tmp_path), buckets=4)
    assert rows(two.bm25(["the"], 5)) == rows(S.bm25(docs.where("doc_id < 20"), ["the"], 5))


def test_an_empty_index(spark, docs, tmp_path):
    x = PostingIndex(spark, str(tmp_path), buckets=4)
    for _ in range(2):
        assert x.bm25(["the"]).collect() == [] and x.phrase("of the").collect() == [] and x.match(["the"]).collect() == []
        x.add(docs.limit(0))
