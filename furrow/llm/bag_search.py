"""Ranked lexical search by bag deduplication.

Documents are restricted to the vocabulary of the queries. What is left of a
document is its *bag*: the vocabulary terms that it holds, with their counts.
Documents with the same bag and the same length factor ``m`` get the same score
from every query. They form a class, which is scored once.

1. *Bags.* Every whole text is split once; the worker keeps the number of its
   terms and the counts of vocabulary terms, sorted by term number.
2. *Statistics* over all documents: N, L, and each term's document frequency
   (summed over classes, weighted by their members).
3. *Classes.* Grouped by a hash of (m, bag) followed by m and the bag itself,
   so documents with one hash but different bags stay apart.
4. *Scores.* Each task adds up its classes' term contributions for all items
   and keeps the ``k`` best classes of each item, ordered by score and smallest
   member id. Those contain the ``k`` best documents: a class behind ``k``
   others has every member behind their smallest members.
5. *Expansion.* Of the best classes only, the ``k`` smallest member ids are
   found (salted, so a class may hold a third of all rows) and ranked.

Scale: documents are never shuffled; bags hold the vocabulary terms only. Items
are dealt to groups of about ``GROUP_TERMS`` (item, term) pairs, and each group
is searched over all documents; only one group's terms are broadcast, and a
group is never smaller than one item. Few items are one group.

Defined results: null and empty texts have no terms, never score, and do not
count in N; an item without terms has no rows; ties go to the smaller id, null
ids last; repeated rows and repeated items are ranked each; an empty table
gives an empty result; other columns are ignored. Scores are whole numbers,
added as doubles below 2^53, so they are exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.topk import top_k_per_group
from furrow.llm.common import documents, ship_package, staged
from furrow.sources.tables import load

K = 50
GROUP_TERMS = 250_000
#: Class rows times items that are scored at a time.
CELLS = 1 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id

#: ASCII letters and digits and all other bytes from 128 on are parts of terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _bytes(batch, name: str) -> list:
    return batch[name].cast(pa.binary()).to_pylist()


def _item_terms(batches):
    for b in batches:
        terms = [sorted(set(terms_of(t))) for t in _bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b["iid"], b["item_id"], pa.array(terms, pa.list_(pa.binary()))],
                                         names=["iid", "item_id", "terms"])


def _bags(shared):
    """Rows (rid, doc_id, text) -> (rid, doc_id, n, terms, tfs)."""
    def run(batches):
        number = shared.value["number"].get
        for b in batches:
            n, terms, tfs = [], [], []
            for text in _bytes(b, "text"):
                words = terms_of(text)
                bag = Counter(map(number, words))
                bag.pop(None, None)
                own = sorted(bag)
                n.append(len(words))
                terms.append(own)
                tfs.append([bag[t] for t in own])
            yield pa.RecordBatch.from_arrays(
                [b["rid"], b["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["rid", "doc_id", "n", "terms", "tfs"])
    return run


def contribution(weight, tf, m):
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The k best classes of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items)
        self.rows = [np.empty((0,), dtype=t) for t in (np.int64, np.float64, np.int64, np.int64)]
        self.open, self.count = [], 0

    def add(self, scores: np.ndarray, first: np.ndarray, cid: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least)
        self.open.append((item, scores[at, item], first[at], cid[at]))
        self.count += len(at)
        if self.count > 4 * self.k * len(self.least):
            self.prune()

    def prune(self) -> None:
        rows = [np.concatenate([r, *(o[i] for o in self.open)]) for i, r in enumerate(self.rows)]
        item, score, first, cid = rows
        order = np.lexsort((cid, first, -score, item))
        rows = item, score, first, cid = [r[order] for r in rows]
        place = np.arange(len(item)) - np.searchsorted(item, np.arange(len(self.least)))[item]
        self.least[item[place == self.k - 1]] = score[place == self.k - 1]
        self.rows, self.open, self.count = [r[place < self.k] for r in rows], [], 0


def _score(shared, k: int):
    """Classes (cid, m, terms, tfs, first) -> (item, cid, first, score): the k
    best classes of each item among this task's."""
    def run(batches):
        weights, starts, items, n = (shared.value[x] for x in ("weights", "starts", "items", "n"))
        best = Best(n, k)
        for b in batches:
            cid, m = b["cid"].to_numpy(), b["m"].to_numpy()
            first = b["first"].fill_null(LAST).to_numpy()
            lists = b["terms"]
            ends = lists.offsets.to_numpy().astype(np.int64)
            term = lists.values.to_numpy().astype(np.int64)
            tf = b["tfs"].values.to_numpy()[b["tfs"].offsets[0].as_py():]
            term, ends = term[ends[0]:], ends - ends[0]
            step = max(1, CELLS // n)
            for lo in range(0, len(cid), step):
                hi = min(lo + step, len(cid))
                here = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                t = term[here]
                value = contribution(weights[t], tf[here], m[lo + row]).astype(np.float64)
                # a row for each item that holds the term
                many = starts[t + 1] - starts[t]
                at = np.repeat(starts[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(row * n, many) + items[at]
                scores = np.bincount(cell, weights=np.repeat(value, many), minlength=(hi - lo) * n).reshape(hi - lo, n)
                best.add(scores, first[lo:hi], cid[lo:hi])
        best.prune()
        item, score, first, cid = best.rows
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), pa.array(cid), pa.array(first, mask=first == LAST), pa.array(score.astype(np.int64))],
                names=["item", "cid", "first", "score"])
    return run


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_group(docs: DataFrame, items: list, k: int) -> DataFrame:
    """``docs`` (rid, doc_id, text) for one group of items (item_id, terms)."""
    spark = docs.sparkSession
    vocabulary = sorted({bytes(t) for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    by_term = sorted((number[bytes(t)], i) for i, (_, terms) in enumerate(items) for t in terms)
    starts = np.searchsorted([t for t, _ in by_term], np.arange(len(vocabulary) + 1)).astype(np.int64)
    sent = spark.sparkContext.broadcast({"number": number})
    bags = staged(docs.mapInArrow(_bags(sent), "rid bigint, doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"),
                  "search-bags")
    n, total = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    total = int(total or 0)
    # exact beyond 64 bits, as documents may be many
    m = F.expr(f"50 + (50 * cast(n as decimal(18,0)) * cast({n} as decimal(18,0))) div cast({max(total, 1)} as decimal(20,0))")
    held = bags.filter(F.size("terms") > 0).withColumn("m", m.cast("bigint")).withColumn("h", F.xxhash64("m", "terms", "tfs"))
    classes = staged(held.groupBy("h", "m", "terms", "tfs").agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")), "search-classes")
    # one row per vocabulary term at most
    df = {r[0]: int(r[1]) for r in classes.select(F.explode("terms").alias("t"), "members").groupBy("t").agg(F.sum("members")).collect()}
    weights = np.array([term_weight(n, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    shared = spark.sparkContext.broadcast({"weights": weights, "starts": starts, "n": len(items),
                                           "items": np.array([i for _, i in by_term], dtype=np.int64)})
    scored = staged(classes.select("cid", "m", "terms", "tfs", "first").mapInArrow(
        _score(shared, k), "item int, cid bigint, first bigint, score bigint"), "search-scored")
    best = top_k_per_group(scored, ["item"], [F.desc("score"), F.asc_nulls_last("first"), F.asc("cid")], k).select("item", "cid", "score")
    best = staged(best, "search-best")
    wanted = classes.join(best.select("cid").distinct(), "cid", "left_semi").select("cid", "h", "m", "terms", "tfs")
    members = held.select("doc_id", "rid", "h", "m", "terms", "tfs").join(wanted, ["h", "m", "terms", "tfs"]).select("cid", "doc_id", "rid")
    members = top_k_per_group(members, ["cid"], [F.asc_nulls_last("doc_id"), F.asc("rid")], k).select("cid", "doc_id", "rid")
    found = top_k_per_group(best.join(members, "cid"), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")], k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id bigint")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text)
    for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = staged(items.select(F.monotonically_increasing_id().alias("iid"), F.col("item_id").cast("bigint").alias("item_id"), "text")
                   .mapInArrow(_item_terms, "iid bigint, item_id bigint, terms array<binary>").filter(F.size("terms") > 0), "search-items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-pairs // group_terms)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64("iid"), F.lit(groups)) == g).select("item_id", "terms").collect()
        if own:
            out = out.unionByName(_search_group(texts, [tuple(r) for r in own], k))
    return out


def op12_bag_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


QUERIES = {"op12_bag_search": op12_bag_search}
ORACLES = {"op12_bag_search": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t),
c AS (
  SELECT tf.doc_id, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * n.n * s.n_docs) // s.n_terms))) AS score
  FROM tf JOIN w USING (t) JOIN n USING (doc_id), s),
r AS (
  SELECT i.item_id, c.doc_id, sum(c.score)::BIGINT AS score FROM i JOIN c USING (t) GROUP BY 1, 2 HAVING sum(c.score) > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r)
WHERE rank <= 50"""}
