"""Reading the provided parquet tables and registering them for SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from furrow.session import path_exists

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> list[str]:
    """Expose a directory of tables as temp views for ``spark.sql``; tables
    that are not there (on whatever file system) are left out."""
    done = []
    for n in names:
        if path_exists(spark, table_path(sf_dir, n)):
            load(spark, sf_dir, n).createOrReplaceTempView(n)
            done.append(n)
    return done


def read_files(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None, **options) -> DataFrame:
    """Parquet / CSV / JSON input. Text formats take an explicit schema so
    no inference pass runs over the data."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"{fmt} input needs an explicit schema")
    return r.load(path)


CORRUPT = "_corrupt"


def read_with_rejects(spark: SparkSession, path: str, fmt: str, schema: StructType | str, **options) -> tuple[DataFrame, DataFrame]:
    """R9 for files with bad records: ``(rows, rejects)``.

    ``rows`` are the records that the schema fits as a whole. ``rejects`` are
    all others: file, record (the text as it stands in the file) and parsed
    (what could be read of it). Every field is parsed whatever a query selects,
    as a record is not good because its bad field is not looked at.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("only csv and json files have bad records")
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = (spark.read.format(fmt).schema(StructType([*wanted.fields, StructField(CORRUPT, StringType())]))
              .options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false", **options).load(path))
    # The record hangs on all fields (by a hash, whatever it is): Spark refuses
    # to read the corrupt record alone, and a reader that is asked for some
    # fields only would not notice that others are bad.
    hashed = [f.name for f in wanted.fields if "map<" not in f.dataType.simpleString()]
    record = F.when(F.xxhash64(*hashed) >= F.lit(-(1 << 63)), F.col(CORRUPT))
    whole = parsed.select(F.col("_metadata.file_path").alias("file"), record.alias("record"), F.struct(*wanted.names).alias("parsed"))
    bad = F.col("record").isNotNull()
    return whole.where(~bad).select("parsed.*"), whole.where(bad)
