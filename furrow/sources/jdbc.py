"""JDBC in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               column_types: str | None = None, batch_size: int = 10_000, **props) -> None:
    """Batched JDBC write, one connection per partition."""
    w = (df.write.format("jdbc").option("url", url).option("dbtable", table)
         .option("batchsize", str(batch_size)).mode(mode))
    if column_types:
        w = w.option("createTableColumnTypes", column_types)
    for k, v in props.items():
        w = w.option(k, v)
    w.save()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None,
              partitions: int = 1, **props) -> DataFrame:
    """JDBC read. With a numeric ``column`` its range is asked for first and the
    table is read in that many ``partitions``; without, in one task."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and partitions > 1:
        q = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b"
        lo, hi = read_jdbc(spark, url, q, **props).first()
        if lo is not None:
            r = (r.option("partitionColumn", column).option("lowerBound", str(lo))
                 .option("upperBound", str(hi)).option("numPartitions", str(partitions)))
    for k, v in props.items():
        r = r.option(k, v)
    return r.load()
