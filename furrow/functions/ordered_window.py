"""Ordered window functions that stay bounded when one partition key is huge.

``row_number``/``rank``, running sums, ``lag`` and ``lead`` over
``partition by P order by O`` normally send every row of a key to one task.
Here:

1. rows are range-partitioned on ``(P, O)``; Spark samples the sort key, so a
   hot key's rows are spread over several consecutive chunks;
2. the chunk id (``spark_partition_id``) is pinned with a reliable
   ``checkpoint`` (it must not change if a task is recomputed);
3. each (chunk, key) slice is windowed locally - at most one chunk of rows;
4. only a chunk's first and last key can continue in a neighbouring chunk,
   so a summary (row count, sums, first and last row) of those at most
   ``2 * chunks`` (chunk, key) slices is windowed per key over chunk order,
   giving the carry from earlier chunks and the neighbours across borders;
   this table has a proven size bound and is broadcast back;
5. local results plus carries are the exact global results.

Rows with equal ``(P, O)`` always land in the same chunk, so ``rank`` (ties
share a rank) is exact too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir


def ordered_window(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                   row_number: str | None = None, rank: str | None = None,
                   running_sums: dict[str, str] | None = None,
                   lags: dict[str, str] | None = None, leads: dict[str, str] | None = None,
                   chunks: int | None = None) -> DataFrame:
    """Add the requested window columns.

    ``running_sums`` / ``lags`` / ``leads`` map output column -> input column
    (frame: unbounded preceding .. current row; offset 1).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    running_sums, lags, leads = running_sums or {}, lags or {}, leads or {}
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_cols + order_cols]
    pinned = (df.repartitionByRange(n, *keys)
              .withColumn("_chunk", F.spark_partition_id())
              .checkpoint(eager=True))

    local_w = Window.partitionBy("_chunk", *partition_cols).orderBy(*order_cols)
    run_w = local_w.rowsBetween(Window.unboundedPreceding, 0)
    local = pinned.withColumn("_rn", F.row_number().over(local_w))
    if rank:
        local = local.withColumn("_rk", F.rank().over(local_w))
    for out, c in running_sums.items():
        local = local.withColumn(f"_rs_{out}", F.sum(c).over(run_w))
    for out, c in lags.items():
        local = local.withColumn(f"_lag_{out}", F.lag(c).over(local_w))
    for out, c in leads.items():
        local = local.withColumn(f"_lead_{out}", F.lead(c).over(local_w))

    # Only the first and the last key of a chunk can continue in a neighbour
    # chunk (rows are range-partitioned on (key, order)), so carries are
    # needed for at most 2 * chunks (chunk, key) slices: a proven bound, so
    # that table is broadcast and the rows never shuffle for the carry join.
    kstruct = F.struct(*[F.col(c) for c in partition_cols])
    edges = (pinned.groupBy("_chunk").agg(F.min(kstruct).alias("_lo"), F.max(kstruct).alias("_hi"))
             .select(F.explode(F.array("_lo", "_hi")).alias("_k")).distinct()
             .select(*[F.col(f"_k.{c}").alias(c) for c in partition_cols]))
    # null-safe key equality: a null key is one group, as in a window
    edge_rows = pinned.join(F.broadcast(edges), _same(pinned, edges, partition_cols), "left_semi")

    order_struct = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    aggs += [F.sum(c).alias(f"_sum_{out}") for out, c in running_sums.items()]
    aggs += [F.max_by(F.col(c), order_struct).alias(f"_last_{out}") for out, c in lags.items()]
    aggs += [F.min_by(F.col(c), order_struct).alias(f"_first_{out}") for out, c in leads.items()]
    summary = edge_rows.groupBy("_chunk", *partition_cols).agg(*aggs)
    sw = Window.partitionBy(*partition_cols).orderBy("_chunk")
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        F.col("_chunk").alias("_c_chunk"), *[F.col(c).alias(f"_c_{c}") for c in partition_cols],
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_c_cnt"),
        # stays null while nothing but nulls came before, as in a plain window
        *[F.sum(f"_sum_{o}").over(before).alias(f"_c_sum_{o}") for o in running_sums],
        *[F.lag(f"_last_{o}").over(sw).alias(f"_c_prev_{o}") for o in lags],
        *[F.lead(f"_first_{o}").over(sw).alias(f"_c_next_{o}") for o in leads])

    local = local.withColumn("_cnt", F.count(F.lit(1)).over(
        Window.partitionBy("_chunk", *partition_cols)))
    cond = (local["_chunk"] == carry["_c_chunk"])
    for c in partition_cols:
        cond = cond & local[c].eqNullSafe(carry[f"_c_{c}"])
    out = local.join(F.broadcast(carry), cond, "left")
    out = out.withColumn("_c_cnt", F.coalesce("_c_cnt", F.lit(0)))
    if row_number:
        out = out.withColumn(row_number, (F.col("_rn") + F.col("_c_cnt")).cast("bigint"))
    if rank:
        out = out.withColumn(rank, (F.col("_rk") + F.col("_c_cnt")).cast("bigint"))
    for o in running_sums:
        local_sum, carried = F.col(f"_rs_{o}"), F.col(f"_c_sum_{o}")
        out = out.withColumn(o, F.when(carried.isNull(), local_sum)
                             .otherwise(F.coalesce(local_sum, carried - carried) + carried))
    for o in lags:
        out = out.withColumn(o, F.when(F.col("_rn") == 1, F.col(f"_c_prev_{o}"))
                             .otherwise(F.col(f"_lag_{o}")))
    for o in leads:
        out = out.withColumn(o, F.when(F.col("_rn") == F.col("_cnt"), F.col(f"_c_next_{o}"))
                             .otherwise(F.col(f"_lead_{o}")))
    return out.select(*df.columns, *([row_number] if row_number else []), *([rank] if rank else []),
                      *running_sums, *lags, *leads)


def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond
