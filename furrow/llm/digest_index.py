"""Exact deduplication against a persistent digest index.

The index is a Parquet table of one row per distinct text: ``digest`` (SHA-256
of the normalised text), ``keep_id`` and ``load``. It is bucketed and sorted by
digest, lives in a folder that the caller names, and outlives the session: it
is opened again by its path. The bucket count is part of the folder's name.

A load is deduplicated in three steps. Its rows are aggregated to one row per
digest (partial aggregates first, so a text held by a third of all rows costs
one row per task). A sort-merge anti-join against the index leaves the digests
that are new; the index side is read bucket by bucket and never shuffled. The
new digests are appended, one file per bucket. An aborted load appends nothing,
and a load that is run again appends nothing twice and decides the same.

``resolve`` gives every row its decision. Groups with more than 1 / ``HOT`` of
all rows, at most ``HOT`` of them, are joined by broadcast, so that no task
gets such a group; all others by a sort-merge join on the digest.

Only built-in expressions run; texts are read once and never shuffled by the
query. ``deduplicate``, which returns whole rows, shuffles one row per text.

Defined results: a null text is an empty one, and all empty texts are one
group; ids that are null come last, so such a row stays only where no row of
its group has an id; of rows equal in text and id one stays; an empty table
gives an empty result; other columns are ignored, or carried by
``deduplicate``. Loads must arrive oldest first: a text that the index knows is
dropped whatever its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import documents, shuffle_partitions, staged, text_or_empty
from furrow.session import scratch_path

#: Runs that one space replaces; a lone space already is one.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
HOT = 256


def normalised(col: Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(col, SPACES, " ")


def text_digest(col: Column) -> Column:
    return F.unhex(F.sha2(normalised(col).cast("binary"), 256))


class DigestIndex:
    """A digest index below ``path``, created there if it is missing."""

    COLUMNS = "digest BINARY, keep_id BIGINT, load STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/digests-{buckets}"
        self.table = f"digests_{uuid.uuid4().hex}"
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) "
                  f"SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the session's name of the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def new_digests(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id) of those texts that the index does not hold."""
        # written, as Spark would otherwise join before it aggregates
        first = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "dedup-first")
        return first.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def admit(self, rows: DataFrame, load: str) -> None:
        """Append the new texts of ``rows`` (doc_id, digest) under a load's name."""
        new = self.new_digests(rows).select("digest", "keep_id", F.lit(load).alias("load"))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)

    def resolve(self, rows: DataFrame, load: str | None = None) -> DataFrame:
        """``rows`` (doc_id, rid, digest) with keep_id, group_size (rows of the
        text in ``rows``) and kept; with ``load``, a row stays only if that load
        brought its text."""
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min_by("rid", "doc_id").alias("at"),
                                           F.min("rid").alias("any"), F.count(F.lit(1)).alias("group_size"))
        known = self.read().hint("merge")
        brought = F.lit(True) if load is None else F.col("load") == load
        groups = staged(first.join(known, "digest").select(
            "digest", "keep_id", "group_size",
            F.when(brought & F.col("keep_id").eqNullSafe(F.col("least")), F.coalesce("at", "any")).alias("stays")),
            "dedup-groups")
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        is_hot = F.col("group_size") > total / HOT  # so there are fewer than HOT
        hot = F.broadcast(groups.filter(is_hot))
        decided = rows.join(hot, "digest").unionByName(
            rows.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(~is_hot), "digest"))
        return decided.select("doc_id", "rid", "digest", "keep_id", "group_size",
                              F.col("rid").eqNullSafe(F.col("stays")).alias("kept"))


def digest_rows(docs: DataFrame) -> DataFrame:
    """Written rows (doc_id, rid, digest); rid tells repeated rows apart."""
    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                              F.monotonically_increasing_id().alias("rid"),
                              text_digest(text_or_empty()).alias("digest")), "dedup-digests")


def load_in_order(index: DigestIndex, rows: DataFrame, loads: int = 2) -> None:
    """Admit ``rows`` as ``loads`` loads of ascending ids, null ids last, each
    against what the earlier ones appended."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = int(low or 0), int(high or 0)
    part = F.lit(0)
    for i in range(1, loads):
        part = part + (F.col("doc_id") >= low + -(-(high - low + 1) * i // loads)).cast("int")
    dealt = rows.withColumn("part", F.coalesce(part, F.lit(loads - 1)))
    for i in range(loads):
        index.admit(dealt.filter(F.col("part") == i), f"load-{i}")


def deduplicate(docs: DataFrame, index: DigestIndex, load: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the index did not know
    before ``load``, one of each text; of rows equal in id and normalised text
    the one whose own text is smallest."""
    rows = digest_rows(docs)
    index.admit(rows, load)
    keep = index.resolve(rows, load).filter("kept").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"))
    whole = docs.select(text_digest(text_or_empty()).alias("_digest"), F.col("doc_id").cast("bigint").alias("_id"),
                        F.struct(*docs.columns).alias("_row"), text_or_empty().alias("_text"))
    one = whole.groupBy("_digest", "_id").agg(F.min_by("_row", "_text").alias("_row"))
    # inner, as a semi-join would run before the aggregate; keep has each text once
    return one.join(keep, (F.col("_digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_row.*")


def op11_digest_index(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), shuffle_partitions(docs))
    rows = digest_rows(docs)
    load_in_order(index, rows)
    out = index.resolve(rows).select("doc_id", "keep_id", "group_size", "kept",
                                     F.lower(F.hex("digest")).alias("text_sha256"))
    index.close()
    return out


QUERIES = {"op11_digest_index": op11_digest_index}
ORACLES = {"op11_digest_index": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)"""}
