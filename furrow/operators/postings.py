"""A stored inverted index (R6): queries read their terms' postings only.

``postings`` holds one row per (term, document): how often and at which
positions the term occurs, and the document's length. The table is bucketed and
sorted by ``cell``. A query filters on a few cells, so Spark prunes the scan to
their buckets and, inside them, to the row groups that can hold the cell.

A cell is a term, or a slice of a term's documents: a term held by more than
``slice_docs`` documents is spread over as many cells as it needs, so that no
bucket, writing task or reading task gets all documents of a common word.
``terms`` (bucketed by term) knows a term's document frequency and cells, and
``documents`` the length of each document.

``add`` indexes more documents: all three tables grow by appends and a query
adds up what the loads say. A document is indexed as a whole and once; adding
its id again would count it twice.

Texts are split as everywhere else (``search.tokens``). A null text is an empty
one: it has no postings, counts as a document and has length 0.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.search import B, K1, TOKEN_SPLIT, tokens
from furrow.session import staged

SLICE_DOCS = 1_000_000
#: Postings that one task sorts and writes.
PIECE_ROWS = 2_000_000


def _cell(term: Column, part: Column) -> Column:
    return F.concat_ws("\u0001", term, part.cast("string"))


def _words(terms: Column) -> Column:
    """(term, positions) of each word of a text: its (term, position) pairs are
    sorted and cut where another term begins."""
    def cut(pairs):
        starts = F.filter(F.transform(pairs, lambda p, i: F.when((i == 0) | (F.get(pairs, i - 1)["term"] != p["term"]), i)),
                          lambda i: i.isNotNull())
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda start, j: F.struct(
            F.get(pairs, start)["term"].alias("term"),
            F.transform(F.slice(pairs, start + 1, F.coalesce(F.get(at, j + 1), F.size(pairs)) - start),
                        lambda p: p["pos"]).alias("positions")))), F.lit(0))

    pairs = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    # inside a lambda the pairs are a variable: they are sorted once
    return F.get(F.transform(F.array(pairs), cut), F.lit(0))


def _earlier(by: int):
    return lambda position: position - by


class PostingIndex:
    TABLES = {
        "postings": ("cell STRING, term STRING, doc_id BIGINT, tf INT, positions ARRAY<INT>, length INT", "cell"),
        "terms": ("term STRING, df BIGINT, cells INT", "term"),
        "documents": ("doc_id BIGINT, length INT", "doc_id"),
    }

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slice_docs: int = SLICE_DOCS):
        """The index below ``path``, created if it is missing. The bucket count
        is part of the folders' names."""
        self.spark, self.buckets, self.slice_docs = spark, buckets, slice_docs
        name = hashlib.md5(path.encode()).hexdigest()[:16]
        self.names = {t: f"{t}_{name}_{buckets}" for t in self.TABLES}
        for t, (columns, key) in self.TABLES.items():
            where = f"{path.rstrip('/')}/{t}-{buckets}".replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns}) USING parquet CLUSTERED BY ({key}) "
                      f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{where}'")

    def table(self, name: str) -> DataFrame:
        self.spark.catalog.refreshTable(self.names[name])
        return self.spark.table(self.names[name])

    def _append(self, name: str, rows: DataFrame, pieces: int = 1) -> None:
        """Each bucket is written by ``pieces`` tasks: a row's bucket is its
        hash modulo the buckets, so a multiple of their number keeps buckets apart."""
        columns = [f.name for f in self.spark.table(self.names[name]).schema.fields]
        rows = rows.repartition(self.buckets * pieces, self.TABLES[name][1])
        if name == "postings":  # what follows from other columns is not shuffled
            rows = rows.withColumn("term", F.substring_index("cell", "\u0001", 1)).withColumn("tf", F.size("positions"))
        rows.select(*columns).write.insertInto(self.names[name])

    # -- building

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Index ``docs``. Texts are split once, and the positions of a text's
        words are found in its own row; postings are shuffled once, to their
        buckets. Repeated rows (equal id and length) are one document."""
        split = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                            tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
        found = staged(split.select("doc_id", F.size("_t").alias("length"), _words(F.col("_t")).alias("words")), "postings-found")
        counted = staged(found.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("n")), "postings-documents")
        held = self._held(found, counted.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("length").alias("_length")))
        terms = staged(held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                       .withColumn("cells", F.ceil(F.col("df") / self.slice_docs).cast("int")), "postings-terms")
        # only terms of several cells are looked up: at most postings / slice_docs
        common = terms.where("cells > 1").select("term", "cells")
        part = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cells")))
        rows = held.join(common, "term", "left").select(_cell(F.col("term"), part).alias("cell"), "doc_id", "positions", "length")
        total = terms.agg(F.sum("df")).first()[0] or 0
        self._append("postings", rows, max(1, math.ceil(total / self.buckets / PIECE_ROWS)))
        self._append("documents", counted.select("doc_id", "length"))
        self._append("terms", terms)

    def _held(self, found: DataFrame, repeated: DataFrame) -> DataFrame:
        """(doc_id, length, term, positions) of all words; those of repeated
        rows are put together."""
        every = found.select("doc_id", "length", F.inline("words"))
        if repeated.isEmpty():
            return every
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("length") == F.col("_length"))
        merged = (every.join(repeated, same, "left_semi").groupBy("doc_id", "length", "term")
                  .agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")))
        return found.join(repeated, same, "left_anti").select("doc_id", "length", F.inline("words")).unionByName(merged)

    # -- reading

    def lookup(self, terms: list[str]) -> dict[str, tuple[int, int]]:
        """Per known term (document frequency, cells); one row a term."""
        rows = (self.table("terms").where(F.col("term").isin(terms)).groupBy("term")
                .agg(F.sum("df").alias("df"), F.max("cells").alias("cells")).collect())
        return {r["term"]: (r["df"], r["cells"]) for r in rows}

    def read(self, known: dict[str, tuple[int, int]]) -> DataFrame:
        """The postings of the terms: a scan of their cells' buckets."""
        cells = [f"{t}\u0001{i}" for t, (_, n) in known.items() for i in range(n)]
        return self.table("postings").where(F.col("cell").isin(cells)) if cells else self.table("postings").limit(0)

    # -- queries

    def bm25(self, terms: list[str], k: int = 20, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
        """The ``k`` best documents: doc_id, score (ties by id); the scores of
        ``search.bm25``."""
        known = self.lookup(sorted({t.lower() for t in terms}))
        n, mean = self.table("documents").agg(F.count(F.lit(1)), F.avg("length")).first()
        weight = F.lit(0.0)
        for t, (df, _) in known.items():
            weight = F.when(F.col("term") == t, math.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(weight)
        norm = k1 * (1 - b + b * F.col("length") / (mean or 1.0))
        score = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
        return (self.read(known).groupBy("doc_id").agg(F.round(F.sum(score), digits).alias("score"))
                .orderBy(F.desc("score"), F.asc("doc_id")).limit(k))

    def match(self, must: list[str] = (), must_not: list[str] = (), should: list[str] = ()) -> DataFrame:
        """doc_id of documents with every ``must`` term, no ``must_not`` term
        and, if given, at least one ``should`` term."""
        must, must_not, should = (list(dict.fromkeys(t.lower() for t in x)) for x in (must, must_not, should))
        if not (must or must_not or should):
            return self.table("documents").select("doc_id")
        found = self.read(self.lookup([*must, *must_not, *should])).groupBy("doc_id").agg(
            *[F.max(F.col("term") == t).alias(f"_{i}") for i, t in enumerate([*must, *must_not, *should])])
        if not must and not should:  # any document may qualify
            found = self.table("documents").select("doc_id").join(found, "doc_id", "left")
        keep, at = F.lit(True), 0
        for group, wanted in ((must, True), (must_not, False)):
            for _ in group:
                keep = keep & (F.coalesce(F.col(f"_{at}"), F.lit(False)) == wanted)
                at += 1
        if should:
            keep = keep & F.greatest(*[F.col(f"_{i}") for i in range(at, at + len(should))], F.lit(False))
        return found.where(keep).select("doc_id")

    def phrase(self, text: str) -> DataFrame:
        """doc_id, starts: the positions at which the words of ``text`` follow
        one another."""
        words = [r[0] for r in self.spark.sql("SELECT explode(filter(split(lower(:t), :s), x -> x <> ''))",
                                              args={"t": text, "s": TOKEN_SPLIT}).collect()]
        known = self.lookup(sorted(set(words)))
        if not words or len(known) < len(set(words)):
            return self.spark.createDataFrame([], "doc_id bigint, starts array<int>")
        per = self.read(known).groupBy("doc_id").agg(
            *[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"_{t}") for t in known])
        starts = None
        for i, w in enumerate(words):
            own = F.transform(F.col(f"`_{w}`"), _earlier(i))
            starts = own if starts is None else F.array_intersect(starts, own)
        return per.select("doc_id", starts.alias("starts")).where(F.size("starts") > 0)
