import hashlib
import re
from collections import defaultdict

from helpers import corpus, empty, frame

from furrow.llm import digest_index as D
from furrow.session import scratch_path


def digest_of(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[digest_of(r[1])].append(r[0])
    out = []
    for d, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        seen = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), not seen, d))
            seen = True
    return sorted(out, key=str)


def index(spark, path=None, buckets=4):
    return D.DigestIndex(spark, path or scratch_path(spark, "test-index"), buckets)


def resolved(spark, df, loads):
    x = index(spark)
    rows = D.digest_rows(df)
    D.load_in_order(x, rows, loads)
    got = x.resolve(rows).selectExpr("doc_id", "keep_id", "group_size", "kept", "lower(hex(digest))").collect()
    return sorted((tuple(r) for r in got), key=str)


AWKWARD = [(90, "a \t b", "en", "s", 1), (91, "a b", "en", "s", 1), (92, " a b", "en", "s", 1), (93, "a\x0bb\r\nc", "en", "s", 1),
           (94, "a b c", "en", "s", 1), (95, "a b", "en", "s", 1), (None, "only without id", "en", "s", 1),
           (None, "only without id", "en", "s", 1), (None, None, "en", "s", 1), (-5, "", "en", "s", 1)]


def test_decisions_equal_brute_force(spark):
    rows = corpus() + AWKWARD
    for loads in (1, 2, 5):
        assert resolved(spark, frame(spark, rows).repartition(3), loads) == expected(rows)


def test_hot_group_and_wide_ids(spark):
    rows = [(2 ** 62 - i, "the same" if i % 3 == 0 else f"text {i}", None, None, 0) for i in range(900)] + [(-2 ** 62, "the same", None, None, 0)]
    assert resolved(spark, frame(spark, rows), 2) == expected(rows)


def test_empty_table(spark):
    assert resolved(spark, empty(spark), 2) == []
    assert D.deduplicate(empty(spark), index(spark), "a").collect() == []


def test_index_persists_and_reruns(spark):
    path = scratch_path(spark, "test-index")
    first = index(spark, path)
    one = [(i, f"text {i % 7}", "en", "s", 1) for i in range(20)]
    two = [(100 + i, f"text {i}", "en", "s", 1) for i in range(10)] + [(105, "text 8", "de", "s", 1)]
    kept = D.deduplicate(frame(spark, one), first, "monday").collect()
    assert sorted(r.doc_id for r in kept) == list(range(7))
    first.close()
    second = index(spark, path)  # as another session would open it
    assert second.read().count() == 7
    for _ in range(2):  # the same load again appends nothing and decides alike
        kept = D.deduplicate(frame(spark, two), second, "tuesday").collect()
        assert sorted((r.doc_id, r.text, r.lang) for r in kept) == [(105, "text 8", "de"), (107, "text 7", "en"), (109, "text 9", "en")]
        assert second.read().count() == 10


def test_whole_rows_keep_all_columns(spark):
    docs = frame(spark, corpus() + AWKWARD)
    out = D.deduplicate(docs, index(spark), "all")
    assert out.dtypes == docs.dtypes
    want = sorted((str(i), d) for i, _, _, kept, d in expected(corpus() + AWKWARD) if kept)
    assert sorted((str(r.doc_id), digest_of(r.text)) for r in out.collect()) == want


def test_index_side_is_not_shuffled(spark):
    x = index(spark, buckets=8)
    rows = D.digest_rows(frame(spark))
    x.admit(rows, "a")
    plan = x.new_digests(rows)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "LeftAnti" in join and join.count("Exchange") == 1 and "Bucketed: true" in x.new_digests(rows)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
