"""Incremental models (R7): upsert by unique key (latest version wins), full
refresh, and refresh of the partitions that change.

``upsert`` is a union of the current table and the change set followed by a
per-key ``max_by(struct(*), version)``: a single shuffle on the key with
partial aggregation, so a key updated many times in one batch costs one row
per map task before the shuffle.

``merge_partitions`` keeps a partitioned Parquet folder up to date: it reads
and rewrites the partitions in which the changes lie, by Spark's dynamic
partition overwrite; the files of all others stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import path_exists


def upsert(current: DataFrame, changes: DataFrame, key: list[str] | str,
           version_col: str) -> DataFrame:
    """Rows of ``current`` updated/extended by ``changes``; per key the row with
    the highest ``version_col`` wins (ties: ``changes`` win)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in current.columns]
    others = [c for c in cols if c not in keys]
    both = (current.withColumn("_src", F.lit(0))
            .unionByName(changes.select(*cols).withColumn("_src", F.lit(1))))
    rank = F.struct(F.col(version_col), F.col("_src"))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), rank).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*cols)


def full_refresh(store, table: str, df: DataFrame) -> None:
    """The rows of ``df`` replace those of the table, which ``df`` may read: in
    that case they are written down before the table's files go."""
    store.replace(table, df)


def write_partitions(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Replace the partitions that ``df`` has rows in, as a whole."""
    by = [F.col(c) for c in partition_cols]
    (df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def merge_partitions(path: str, changes: DataFrame, key: list[str], partition_cols: list[str]) -> None:
    """Upsert ``changes`` (one row per key; every row of a key lies in one
    partition) into the Parquet folder ``path``. Nulls in a key are equal.

    Running it again with the same changes changes nothing, so a load that
    broke off is simply repeated.
    """
    spark = changes.sparkSession
    columns = changes.columns
    if path_exists(spark, path):
        current = spark.read.schema(changes.schema).parquet(path).select(*columns)
        touched = changes.select(*[F.col(c).alias(f"_{c}") for c in partition_cols]).distinct()
        inside = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_cols])
        taken = changes.select(*[F.col(c).alias(f"_{c}") for c in key])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        rest = current.join(touched, inside, "left_semi").join(taken, same, "left_anti")
        changes = changes.unionByName(rest)
    write_partitions(changes, path, partition_cols)
