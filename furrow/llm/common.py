"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import staged  # noqa: F401 (the operators take it from here)
from furrow.sources.tables import load

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Let Spark send this package to its Python workers, once a session,
    unless they find it on PYTHONPATH as the driver does."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if sc.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="furrow-py-"), "furrow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "furrow").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def documents(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def release(*frames: DataFrame) -> None:
    """Delete the folders of ``staged`` frames that nothing reads any more:
    what was made of them must have been written."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
