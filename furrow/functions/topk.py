"""Top-k per group that stays bounded when one group is huge.

A plain ``row_number() over (partition by g order by ...)`` sorts each whole
group in one task. Here rows are first cut by a salt (a hash of the row), the
top ``k`` are kept per (group, salt), and only those ``k * salts`` candidates
per group meet in the final window. The result is exact: every row of the
global top ``k`` is in the top ``k`` of its own salt slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salts: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (which must be a total order)."""
    if k <= 0:
        raise ValueError("k must be positive")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt)
             .withColumn("_r", F.row_number().over(w1))
             .where(F.col("_r") <= k).drop("_r", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k: Spark plans ``orderBy().limit()`` as TakeOrderedAndProject,
    which keeps k rows per partition and merges them (no full sort)."""
    return df.orderBy(*order).limit(k)
