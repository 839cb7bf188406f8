"""Declared rules of a table (K1) and their check over whole tables (K9)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.conflicts import all_present


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str                 # table of the same store
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """What a table demands of its rows."""

    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    @staticmethod
    def of(schema: T.StructType, unique=None, foreign_keys=()) -> "Rules":
        """From a schema: NOT NULL of its fields, and a unique key for each
        field that its metadata calls unique unless ``unique`` names the keys."""
        keys = [[f.name] for f in schema.fields if f.metadata.get("unique")] if unique is None else unique
        return Rules(tuple(f.name for f in schema.fields if not f.nullable and not f.metadata.get("identity")),
                     tuple(tuple(k) for k in keys), tuple(foreign_keys))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Rules":
        x = json.loads(text)
        return Rules(tuple(x["not_null"]), tuple(map(tuple, x["unique"])), tuple(
            ForeignKey(tuple(k["columns"]), k["parent"], tuple(k["parent_columns"])) for k in x["foreign_keys"]))


def check_constraints(df: DataFrame, table: str, not_null: list[str] = (),
                      unique: list[list[str]] = (),
                      foreign_keys: list[tuple[list[str], DataFrame, list[str]]] = ()) -> DataFrame:
    """K9: declared constraints as a violation table
    ``(table, constraint, columns, violations)`` (one row per constraint).

    NOT NULL rules share one aggregation pass; UNIQUE is a grouped count of
    keys seen more than once (null keys exempt); FK is a left-anti join.
    """
    out = df.sparkSession.createDataFrame([], "table string, constraint string, columns string, violations bigint")
    name = F.lit(table).alias("table")
    if not_null:
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        out = out.unionByName(agg.unpivot([], list(not_null), "columns", "violations").select(
            name, F.lit("not_null").alias("constraint"), "columns", F.col("violations").cast("bigint").alias("violations")))
    for cols in unique:
        dup = (df.where(all_present(cols)).groupBy(*cols).count().where("count > 1")
               .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("violations")))
        out = out.unionByName(dup.select(name, F.lit("unique").alias("constraint"), F.lit(",".join(cols)).alias("columns"), "violations"))
    for cols, parent, pcols in foreign_keys:
        cols = list(cols)
        ref = parent.select(*[F.col(p).alias(c) for p, c in zip(pcols, cols)]).distinct()
        orphans = df.select(*cols).where(all_present(cols)).join(ref, cols, "left_anti")
        out = out.unionByName(orphans.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).select(
            name, F.lit("foreign_key").alias("constraint"), F.lit(",".join(cols)).alias("columns"), "violations"))
    return out
