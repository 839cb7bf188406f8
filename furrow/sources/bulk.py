"""Bulk files of a search store (K10): what its bulk endpoint takes, as files.

Each row becomes an action line and a document line. Spark writes them as text
files of ``rows_per_file`` rows at most, on any file system; a loader sends the
files as they are. Rows get no ids, so the store assigns them (K2b: loading
twice adds the rows twice). Times are ISO texts, decimals and other numbers
plain numbers; nulls are left out, as the store treats both alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_bulk(df: DataFrame, path: str, index: str, rows_per_file: int = 100_000) -> int:
    """Write ``df`` for ``index``; returns the number of documents, observed
    while they are written."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    written = Observation()
    lines = df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*df.columns), ISO)).alias("value"))
    (lines.observe(written, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", rows_per_file).text(path))
    return int(written.get["n"])


def read_bulk(spark: SparkSession, path: str, schema: StructType | str, index: str | None = None) -> DataFrame:
    """The documents of bulk files (of ``index`` only, if given), read back."""
    lines = spark.read.option("lineSep", "\n{\"index\":").text(path)
    body = F.regexp_replace("value", r'^\{"index":', "")
    named = lines.select(F.get_json_object(F.regexp_extract(body, r"^(\{[^\n]*?\})\}\n", 1), "$._index").alias("index"),
                         F.regexp_extract(body, r"\}\n([\s\S]*?)\n?$", 1).alias("doc"))
    rows = named if index is None else named.where(F.col("index") == index)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.select(F.from_json("doc", wanted, ISO).alias("d")).select("d.*")
