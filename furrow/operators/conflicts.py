"""Which rows an insert-ignore load accepts.

A row is skipped if a unique key of it is taken: by a row of the table, or by a
row of the same load that came earlier and was itself accepted. A key with a
null in it is never taken (SQL ``UNIQUE`` admits many nulls).

With one unique key the accepted rows are the first of each key that the table
does not hold: one aggregate, one join.

With several keys a skipped row must not block later ones, so the outcome is
that of a sequential process. ``insert_ignore_any`` settles it in rounds. Rows
get their arrival number, and each key value is named by the number of the
first row that has it, so rounds handle whole numbers only. Rows that are the
first of all their key values are accepted at once. Then, in a round, every
key value nominates its earliest undecided row; a row that all its key values
nominate has no earlier rival and is accepted, and every other row that shares
a key value with it is skipped. The first undecided row always is accepted, so
rounds end; their number is the length of the longest chain of rows of which
each hangs on the one before (on unordered keys it grows with the logarithm of
the rows). Once at most ``tail`` rows are undecided, one task goes through them
in order, which cuts what is left of long chains.

The numbered load and each round's rows are written as Parquet, of which later
steps read the columns they need. Rounds join by sorting: no side of these joins
has a size bound, and the broadcast tables of several joins of one stage would
all stand in the memory of its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import staged

#: Undecided rows (a few whole numbers each) that one task may settle.
TAIL = 10_000


def all_present(keys: list[str]) -> Column:
    return reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))


def _arrival(df: DataFrame, order_cols: list[str]) -> list[str]:
    """The order columns, then all others: rows that tie in these are equal."""
    return [*order_cols, *(c for c in df.columns if c not in order_cols)]


def first_seen(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Per key the row that comes first in ``order_cols`` (then by the remaining
    columns); rows with a null in the key all pass.

    ``min_by`` aggregates partially before the shuffle, so a key holding a
    third of the load costs one row per map task, not one task of rows. A row
    with a null key is a group of its own, so the input is read once.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in _arrival(df, order_cols) if c not in keys or c in order_cols])
    alone = F.when(~all_present(keys), F.monotonically_increasing_id())
    best = df.groupBy(*keys, alone.alias("_alone")).agg(F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def not_taken(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``existing`` lacks; only its key columns are read. It is
    joined from the outside, as an anti-join would be moved below the aggregate
    that made ``rows``, where a frequent key is not yet one row per task."""
    taken = existing.select(*keys).where(all_present(keys)).distinct().withColumn("_taken", F.lit(True))
    return rows.join(taken, keys, "left").where("_taken IS NULL").select(*rows.columns)


def insert_ignore(existing: DataFrame | None, incoming: DataFrame, keys: list[str] | str,
                  order_cols: list[str]) -> DataFrame:
    """K2a with one unique key: rows of ``incoming`` that the load accepts."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("insert_ignore needs the unique key columns")
    best = first_seen(incoming, keys, order_cols)
    return best if existing is None else not_taken(best, existing, keys)


def _in_order(m: int):
    """Undecided rows in arrival order -> numbers of those accepted."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = [set() for _ in range(m)]
        for frame in frames:
            out = []
            for seq, *groups in zip(frame["_seq"], *(frame[f"_g{j}"] for j in range(m))):
                if not any(g in t for g, t in zip(groups, taken)):
                    out.append(seq)
                    for g, t in zip(groups, taken):
                        if not pd.isna(g):
                            t.add(g)
            yield pd.DataFrame({"_seq": pd.Series(out, dtype="int64")})
    return run


def _undecided(numbered: DataFrame, existing: DataFrame | None, unique_keys: list[list[str]]) -> DataFrame:
    """(_seq, _g0, _g1, ...): per row and key the number of the key value, null
    for a key with a null; rows with a key that the table holds are left out."""
    columns = list(dict.fromkeys(c for keys in unique_keys for c in keys))
    rows = numbered.select("_seq", *columns)
    if existing is not None:  # worked out once for all keys
        existing = staged(existing.select(*columns), "insert-existing")
    for j, keys in enumerate(unique_keys):
        named = numbered.where(all_present(keys)).groupBy(*keys).agg(F.min("_seq").alias(f"_g{j}"))
        if existing is not None:
            held = existing.select(*keys).where(all_present(keys)).distinct().withColumn("_held", F.lit(True))
            named = (named.join(held.hint("merge"), keys, "left").withColumn(f"_h{j}", F.col("_held").isNotNull()).drop("_held"))
        rows = rows.join(named.hint("merge"), keys, "left")
    if existing is not None:
        rows = rows.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_h{j}"), F.lit(False)) for j in range(len(unique_keys))]))
    return rows.select("_seq", *[f"_g{j}" for j in range(len(unique_keys))])


def _numbered(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """``df`` with ``_seq``, which grows in the given order (with gaps); written
    once, so that the numbers stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    return staged(ordered.withColumn("_seq", F.monotonically_increasing_id()), "insert-numbered")


def _without_taken(rows: DataFrame, winners: DataFrame, groups: list[str]) -> tuple[DataFrame, int]:
    """The rows that share no key value with ``winners``, and their number."""
    for g in groups:
        rows = rows.join(winners.where(F.col(g).isNotNull()).select(g).hint("merge"), g, "left_anti")
    rows = staged(rows.select("_seq", *groups), "insert-undecided")
    return rows, rows.count()


def insert_ignore_any(existing: DataFrame | None, incoming: DataFrame, unique_keys: list[list[str]],
                      order_cols: list[str], tail: int = TAIL) -> DataFrame:
    """K2a with several unique keys: the rows of ``incoming`` that a row-by-row
    load in the order of ``order_cols`` (then of all columns) would accept."""
    m = len(unique_keys)
    groups = [f"_g{j}" for j in range(m)]
    numbered = _numbered(incoming, _arrival(incoming, order_cols))
    rows = staged(_undecided(numbered, existing, unique_keys), "insert-undecided")
    leads = reduce(lambda a, b: a & b, [F.col(g).isNull() | (F.col(g) == F.col("_seq")) for g in groups])
    accepted = [rows.where(leads).select("_seq")]
    rows, left = _without_taken(rows.where(~leads), rows.where(leads), groups)
    while left > tail:
        first = [rows.where(F.col(g).isNotNull()).groupBy(g).agg(F.min("_seq").alias("_first")).select("_first") for g in groups]
        nominated = reduce(DataFrame.unionByName, first).groupBy("_first").agg(F.count(F.lit(1)).alias("_n"))
        has = reduce(lambda a, b: a + b, [F.col(g).isNotNull().cast("int") for g in groups])
        winners = staged(rows.join(nominated.hint("merge"), F.col("_seq") == F.col("_first")).where(F.col("_n") == has)
                         .select("_seq", *groups), "insert-winners")
        accepted.append(winners.select("_seq"))
        rows, left = _without_taken(rows, winners, groups)
    if left:
        accepted.append(rows.coalesce(1).sortWithinPartitions("_seq").mapInPandas(_in_order(m), "_seq bigint"))
    kept = reduce(DataFrame.unionByName, accepted)
    return numbered.join(kept.hint("merge"), "_seq", "left_semi").select(*incoming.columns)
