"""Source divergence audit by single-pass in-memory indexing.

Which sources of a language use its words alike, and which words does a source
overuse? All figures follow from how often each kept term occurs in each
(lang, source) group.

1. *Block postings.* A task reads its documents once and counts occurrences and
   documents per group and term in memory. Once it holds ``BLOCK_TERMS``
   postings it spills them as one run, sorted by term, lang and source.
2. *Merge.* Runs go to hash shards of (lang, term). There Spark's external sort
   merges them (a heap over sorted runs), and the merge streams: equal keys
   are added up, a term stays when ten documents of its language hold it.
   What is open between two batches is one term, one row per source.
3. *Pair corrections.* A pair's value is a sum over all kept terms, of which
   most occur in few sources. It starts as if no term occurred (V times one
   figure). Each source then corrects it by its own occurrences (by the
   histogram of its counts), and shards stream, term by term, the corrections
   of pairs of sources that both hold the term.

Scale: what is shuffled is one row per run, group and term; a frequent word is
one row per run and source. The pair corrections of a term are added up in
bounded arrays (``PAIR_ROWS``) and flushed as partial sums. Counts may exceed
2^31; products beyond 64 bits are decimals.

Defined results: null text, lang and source are empty strings; a group without
terms takes part with counts of zero; in a language without kept terms all
pairs are 0 and no term is listed; equal values go to the smaller item by its
UTF-8 bytes; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import documents, ship_package, shuffle_partitions, staged

BLOCK_TERMS = 1 << 20
PAIR_ROWS = 1 << 20
MIN_DOCS = 10
TOP = 10
ONE = 1_000_000_000

#: ASCII letters and all bytes from 128 on are parts of terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

_RUN = "lang string, term binary, source string, n bigint, docs bigint"


def _run_of(block: dict):
    """A block's postings as one run, sorted by term, lang and source. The
    empty term stands for the group itself, so that groups without terms are
    known too."""
    if not block:
        return
    groups = sorted(block)
    size = [len(block[g][0]) for g in groups]
    of = np.repeat(np.arange(len(groups), dtype=np.int32), size)
    terms = pa.array([t for g in groups for t in block[g][0]], pa.binary())
    n = np.fromiter((x for g in groups for x in block[g][0].values()), dtype=np.int64, count=len(of))
    docs = np.fromiter((x for g in groups for x in map(block[g][1].__getitem__, block[g][0])), dtype=np.int64, count=len(of))
    order = pc.sort_indices(pa.table({"term": terms, "of": of}), [("term", "ascending"), ("of", "ascending")])
    lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in range(2))
    for i in range(0, len(of), 1 << 16):
        at = order.slice(i, 1 << 16)
        here = at.to_numpy()
        own = pa.array(of[here])
        yield pa.RecordBatch.from_arrays([lang.take(own), terms.take(at), source.take(own), pa.array(n[here]), pa.array(docs[here])],
                                         names=["lang", "term", "source", "n", "docs"])


def _index(block_terms: int):
    """Rows (lang, source, text) -> sorted runs of postings."""
    def run(batches):
        block, held = {}, 0
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
                counts, docs = block.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(FOLD).split()
                words.append(b"")
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                held += len(counts) - before
                if held >= block_terms:
                    yield from _run_of(block)
                    block, held = {}, 0
        yield from _run_of(block)
    return run


def _changes(columns: list) -> np.ndarray:
    """Where a row's values differ from the row's before it."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def _merge(min_docs: int):
    """Sorted postings of a shard -> (lang, term, source, n, total, first) of
    kept terms: total over the language, first on one row of each term. Group
    rows (empty term) all pass."""
    names = ["lang", "term", "source", "n", "docs"]

    def summed(table):
        at = np.flatnonzero(_changes([table[c] for c in ("lang", "term", "source")]))
        n, docs = (np.add.reduceat(table[c].to_numpy(), at) for c in ("n", "docs"))
        keys = table.take(pa.array(at))
        return pa.RecordBatch.from_arrays([keys["lang"], keys["term"], keys["source"], pa.array(n), pa.array(docs)], names=names)

    def kept(table):
        fresh = _changes([table["lang"], table["term"]])
        at = np.flatnonzero(fresh)
        size = np.diff(np.append(at, len(fresh)))
        total, docs = (np.add.reduceat(table[c].to_numpy(), at) for c in ("n", "docs"))
        group_row = pc.equal(pc.binary_length(table["term"]), 0).to_numpy(zero_copy_only=False)
        keep = np.repeat(docs >= min_docs, size) | group_row
        out = pa.RecordBatch.from_arrays(
            [table["lang"], table["term"], table["source"], table["n"], pa.array(np.repeat(total, size)),
             pa.array(fresh.astype(np.int64))], names=["lang", "term", "source", "n", "total", "first"])
        return out.filter(pa.array(keep))

    def run(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.concat_batches([rest, b.select(names).cast(rest.schema)])
            if not b.num_rows:
                continue
            b = summed(b)
            open_at = int(np.flatnonzero(_changes([b["lang"], b["term"]]))[-1])
            rest = b.slice(open_at)
            if open_at:
                yield kept(b.slice(0, open_at))
        if rest is not None and rest.num_rows:
            yield kept(rest)
    return run


def divergence(p, q):
    return (p - q) * (p - q) // (p + q)


@lru_cache(maxsize=256)
def _pairs(lo: int, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of k places with i in lo .. lo + rows - 1."""
    i, j = np.triu_indices(rows, 1, k - lo)
    return i + lo, j + lo


def _pair_corrections(pair_rows: int):
    """Sorted rows (term, lang, source, p, p0) of a shard -> (lang, a, b, value)
    with a < b: for terms that both sources hold, what the corrections of the
    two single sources miss."""
    def run(batches):
        ids, names, held, count = {}, [], [], 0

        def add_up():
            key, value = (np.concatenate([h[i] for h in held]) for i in range(2))
            pair, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(pair), dtype=np.int64)
            np.add.at(total, at, value)
            return pair, total

        def rows(pair, total):
            a, b = (pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist()
            for i in range(0, len(a), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x][0] for x in a[s]], pa.string()), pa.array([names[x][1] for x in a[s]], pa.string()),
                     pa.array([names[x][1] for x in b[s]], pa.string()), pa.array(total[s])], names=["lang", "a", "b", "value"])

        def terms(number, p, p0):
            """Terms (rows) that k sources (columns) hold each; sources come
            sorted, so a < b."""
            nonlocal held, count
            k = p.shape[1]
            step = max(1, pair_rows // k)
            for lo in range(0, k - 1, step):
                i, j = _pairs(lo, min(step, k - 1 - lo), k)
                block = max(1, pair_rows // len(i))
                for t in range(0, len(p), block):
                    a, b, a0, b0 = p[t:t + block, i], p[t:t + block, j], p0[t:t + block, i], p0[t:t + block, j]
                    value = divergence(a, b) - divergence(a, b0) - divergence(a0, b) + divergence(a0, b0)
                    held.append(((number[t:t + block, i] << 32 | number[t:t + block, j]).ravel(), value.ravel()))
                    count += value.size
                    if count >= 4 * pair_rows:
                        held = [add_up()]
                        count = len(held[0][0])
                        if count >= 2 * pair_rows:
                            yield from rows(*held[0])
                            held, count = [], 0

        def closed(b):
            """The pairs of a batch of whole terms, terms with equally many
            sources together."""
            at = np.flatnonzero(_changes([b["lang"], b["term"]]))
            size = np.diff(np.append(at, b.num_rows))
            for pair in zip(b["lang"].to_pylist(), b["source"].to_pylist()):
                if pair not in ids:
                    ids[pair] = len(names)
                    names.append(pair)
            number = np.fromiter((ids[x] for x in zip(b["lang"].to_pylist(), b["source"].to_pylist())), dtype=np.int64, count=b.num_rows)
            p, p0 = b["p"].to_numpy(), b["p0"].to_numpy()
            for k in np.unique(size[size > 1]).tolist():
                where = at[size == k][:, None] + np.arange(k)
                yield from terms(number[where], p[where], p0[where])

        rest = None
        for b in batches:
            b = pa.concat_batches([rest, b.cast(rest.schema)]) if rest is not None else b
            if not b.num_rows:
                continue
            last = int(np.flatnonzero(_changes([b["lang"], b["term"]]))[-1])
            rest = b.slice(last)
            yield from closed(b.slice(0, last))
        if rest is not None:
            yield from closed(rest)
        if held:
            yield from rows(*add_up())
    return run


def _share(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 V)); null without kept terms. Where
    the product passes 64 bits it is a decimal."""
    return F.expr(f"CASE WHEN v > 0 AND {n} < 9000000000 THEN 1 + ({ONE} * ({n} + 2L)) div ({total} + 2 * v) "
                  f"WHEN v > 0 THEN 1 + ({ONE} * cast({n} + 2L as decimal(28,0))) div cast({total} + 2 * v as decimal(28,0)) END")


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def frequencies(docs: DataFrame, block_terms: int = BLOCK_TERMS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, total, first) of kept terms, and one row with an
    empty term per group."""
    ship_package(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = texts.mapInArrow(_index(block_terms), _RUN)
    shards = runs.repartition(shuffle_partitions(docs), "lang", "term").sortWithinPartitions("term", "lang", "source")
    return staged(shards.mapInArrow(_merge(min_docs), "lang string, term binary, source string, n bigint, total bigint, first bigint")
                  .withColumn("term", F.col("term").cast("string")), "audit-frequencies")


def group_figures(found: DataFrame) -> DataFrame:
    """Per group: lang, source, v, group_total, lang_total, p0 (a term that the
    group lacks)."""
    terms = found.filter("term <> ''")
    langs = terms.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = found.filter("term = ''").select("lang", "source")
    return staged(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0).withColumn(
        "p0", _share("0", "group_total")), "audit-groups")


def term_part(shares: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms that each group overuses most."""
    over = shares.withColumn("q", _share("total", "lang_total")).filter("n > 0 and p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr(_divergence("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", rank).filter(F.col("rank") <= top)


def pair_part(shares: DataFrame, groups: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Each group's divergence from the other sources of its language."""
    parts = shuffle_partitions(shares)
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    none = _divergence("p0", "q0")
    start = groups.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.expr(f"CASE WHEN v > 0 THEN v * ({none}) ELSE 0 END").alias("value"))
    counts = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    single = counts.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"k * ({_divergence('p', 'q0')} - {none})")).alias("value"))
    rows = shares.select("lang", "term", "source", "p", "p0").repartition(parts, "lang", "term").sortWithinPartitions("term", "lang", "source")
    both = staged(rows.mapInArrow(_pair_corrections(pair_rows), "lang string, a string, b string, value bigint")
                  .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-both")
    flipped = F.col("item").alias("source"), F.col("source").alias("item")
    single = staged(single, "audit-single")
    value = (start.unionByName(single).unionByName(single.select("lang", *flipped, "value"))
             .unionByName(both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"))
             .unionByName(both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", rank)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS,
          pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    found = frequencies(docs, block_terms, min_docs)
    groups = group_figures(found)
    shares = staged(found.filter("term <> ''").join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_total")),
                    "audit-shares")
    out = pair_part(shares, groups, pair_rows).withColumn("part", F.lit("pair")).unionByName(
        term_part(shares, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13_spimi_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


QUERIES = {"op13_spimi_divergence": op13_spimi_divergence}
ORACLES = {"op13_spimi_divergence": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc_id, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, t, count(*) AS n FROM t SEMI JOIN k USING (lang, t) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, t)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM part)
WHERE part = 'pair' OR rank <= 10"""}
