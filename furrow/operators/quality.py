"""Expectation suites (R2): declared rules -> one result row per rule.

All row-local rules (not_null, in_set, between, matches_regex, max_length,
column_a_le_b) are evaluated in a single aggregation pass with ``count_if``;
``unique`` is a grouped count and ``foreign_key`` a left-anti join, each one
extra shuffle. Nothing is collected: the result is a small DataFrame.

``evaluated`` counts the rows the rule looks at (non-null values, except for
``not_null`` and ``row_count_between`` which look at every row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expect:
    rule: str
    column: str | tuple[str, ...] = ""
    args: tuple = field(default_factory=tuple)
    ref: DataFrame | None = None        # parent table for foreign_key
    ref_column: str | None = None

    @property
    def name(self) -> str:
        col = ",".join(self.column) if isinstance(self.column, tuple) else self.column
        return f"{self.rule}({col})" if col else self.rule


ROW_RULES = {"not_null", "in_set", "between", "matches_regex", "max_length", "column_a_le_b",
             "row_count_between"}


def _evaluated_and_bad(e: Expect) -> tuple[Column, Column]:
    c = F.col(e.column) if isinstance(e.column, str) and e.column else None
    if e.rule == "not_null":
        return F.count(F.lit(1)), F.count_if(c.isNull())
    if e.rule == "in_set":
        return F.count(c), F.count_if(c.isNotNull() & ~c.isin(*e.args))
    if e.rule == "between":
        lo, hi = e.args
        return F.count(c), F.count_if(c.isNotNull() & ~c.between(lo, hi))
    if e.rule == "matches_regex":
        return F.count(c), F.count_if(c.isNotNull() & ~c.rlike(e.args[0]))
    if e.rule == "max_length":
        return F.count(c), F.count_if(c.isNotNull() & (F.length(c) > e.args[0]))
    if e.rule == "column_a_le_b":
        a, b = (F.col(x) for x in e.column)
        both = a.isNotNull() & b.isNotNull()
        return F.count_if(both), F.count_if(both & (a > b))
    if e.rule == "row_count_between":
        lo, hi = e.args
        n = F.count(F.lit(1))
        return n, F.when((n < lo) | (n > hi), n).otherwise(F.lit(0))
    raise ValueError(f"unknown row rule {e.rule}")


def _row_rules(df: DataFrame, rules: list[Expect]) -> DataFrame:
    aggs = []
    for i, e in enumerate(rules):
        ev, bad = _evaluated_and_bad(e)
        aggs += [ev.cast("bigint").alias(f"e{i}"), bad.cast("bigint").alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(e.name).alias("rule"), F.col(f"e{i}").alias("evaluated"),
                              F.col(f"b{i}").alias("unexpected")) for i, e in enumerate(rules)])
    return one.select(F.inline(rows))


def _unique(df: DataFrame, e: Expect) -> DataFrame:
    cols = list(e.column) if isinstance(e.column, tuple) else [e.column]
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    counts = df.where(present).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("evaluated"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("unexpected"),
    ).select(F.lit(e.name).alias("rule"), "evaluated", "unexpected")


def _foreign_key(df: DataFrame, e: Expect) -> DataFrame:
    """Values of ``e.column`` with no parent key: one left join against the
    distinct parent keys (so a repeated parent key cannot multiply rows) and
    one aggregation."""
    c = e.column
    vals = df.select(F.col(c).alias("_k")).where(F.col("_k").isNotNull())
    parent = (e.ref.select(F.col(e.ref_column or c).alias("_k")).where(F.col("_k").isNotNull())
              .distinct().withColumn("_hit", F.lit(True)))
    return (vals.join(parent, "_k", "left")
            .agg(F.count(F.lit(1)).cast("bigint").alias("evaluated"),
                 F.count_if(F.col("_hit").isNull()).cast("bigint").alias("unexpected"))
            .select(F.lit(e.name).alias("rule"), "evaluated", "unexpected"))


def run_suite(df: DataFrame, expectations: list[Expect], mostly: float = 1.0) -> DataFrame:
    """One row per rule: rule, evaluated, unexpected, unexpected_pct, success."""
    row = [e for e in expectations if e.rule in ROW_RULES]
    parts = [_row_rules(df, row)] if row else []
    for e in expectations:
        if e.rule == "unique":
            parts.append(_unique(df, e))
        elif e.rule == "foreign_key":
            parts.append(_foreign_key(df, e))
        elif e.rule not in ROW_RULES:
            raise ValueError(f"unknown rule {e.rule}")
    out = df.sparkSession.createDataFrame([], "rule string, evaluated bigint, unexpected bigint")
    for p in parts:
        out = out.unionByName(p)
    pct = F.when(F.col("evaluated") > 0,
                 F.round(F.col("unexpected") * 100.0 / F.col("evaluated"), 6)).otherwise(F.lit(0.0))
    ok = F.when(F.col("evaluated") > 0,
                (F.col("evaluated") - F.col("unexpected")) >= F.lit(mostly) * F.col("evaluated")) \
        .otherwise(F.col("unexpected") == 0)
    return out.select("rule", "evaluated", "unexpected", pct.alias("unexpected_pct"), ok.alias("success"))


def failing_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not unique, with the number of copies of their key.

    A grouped count (partial aggregation) joined back on the key; a hot key is
    one row on the count side, and AQE splits the skewed side of the join.
    """
    dups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return df.join(dups, keys, "inner")


def schema_expectations(schema, ordered_after_time_field: bool = True) -> list[Expect]:
    """Expectations implied by a declared schema: NOT NULL for non-nullable
    fields, UNIQUE for unique ones, ``max_length`` for ``VARCHAR(n)``,
    ``in_set`` for enumerated fields and, optionally, every other timestamp
    not before the time field (the generator's rule)."""
    out: list[Expect] = []
    fields = schema.generated_fields()
    for f in fields:
        if not f.nullable:
            out.append(Expect("not_null", f.name))
    for f in fields:
        if f.unique:
            out.append(Expect("unique", f.name))
    for f in fields:
        if f.max_len:
            out.append(Expect("max_length", f.name, (f.max_len,)))
    for f in fields:
        if f.gen and f.gen[0] == "pick":
            out.append(Expect("in_set", f.name, tuple(f.gen[1])))
    if ordered_after_time_field:
        for f in fields:
            if f.sql_type == "TIMESTAMP" and f.name != schema.time_field:
                out.append(Expect("column_a_le_b", (schema.time_field, f.name)))
    return out
