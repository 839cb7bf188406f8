"""Mixing sources to target weights by weighted fair queueing.

Every source has a weight. All sources share a budget of words in proportion
to the weights, but none may be repeated more than ``max_epochs`` times; what
a capped source cannot take is shared again among the others.

Documents of a source are shuffled (by a digest of seed, id and text) and
queued, once per epoch. A copy's *virtual finish time* is the number of its
source's words up to and including it, divided by the source's target. All
copies are range-sorted by that time, and the queue is cut where the budget is
spent: before the copy that would pass it, or behind it if that is nearer.

Scale: only ids, sizes and hashes are sorted, never texts. The running sums
per source and over the whole queue are range-partitioned with carries
(``ordered_window``), so a source with a third of all rows is spread over many
tasks. The driver sees scalars: the totals of each sharing round and the cut.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a document of size 0 is taken for 0 words, and kept once when
copies are written out; repeated rows queue separately; an empty table gives
an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.ids import dense_ids
from furrow.functions.ordered_window import ordered_window
from furrow.llm.common import WORD, documents, staged

WEIGHTS = (5.0, 2.0, 1.0)  # by source in code point order, repeating
MAX_EPOCHS = 3
SEED = 17


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   budget: float = 1.0) -> DataFrame:
    """Per source: ``source``, ``source_rank``, ``source_size``, ``target``.

    ``target = min(max_epochs * size, level * weight)``, where ``level`` is the
    water level at which the targets add up to the budget. It is found by
    sharing again what the capped sources leave, until no source is newly
    capped: each round is one distributed aggregate over the source table.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_ids(per, [F.col("source").asc_nulls_last()], "source_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = staged(ranked.withColumn("weight", w), "mix-sources")
    cap = F.col("source_size") * float(max_epochs)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = 0.0, -1
    while True:
        is_capped = cap < F.col("weight") * level if level else F.lit(False)
        n, used, free = table.agg(
            F.count(F.when(is_capped, 1)),
            F.sum(F.when(is_capped, cap).otherwise(0.0)),
            F.sum(F.when(is_capped, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    return table.withColumn("target", F.least(cap, F.col("weight") * level).cast("double")).drop("weight")


def shuffle_key(seed: int):
    """60 bits of a digest that SQL can repeat."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float = 1.0,
             seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``h`` (shuffle key),
    ``size``, ``source_size``, ``target``, ``pos`` (place in its source's
    queue), ``copies`` (how often the mix takes it) and ``taken`` (words)."""
    rows = staged(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        shuffle_key(seed).alias("h")), "mix-rows")
    targets = staged(source_targets(rows, weights, max_epochs, budget), "mix-targets")
    queued = ordered_window(rows, ["source"], ["h", "doc_id"], row_number="pos",
                            running_sums={"cum": "size"})
    queued = staged(queued.alias("q").join(
        targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source")), "left")
        .select("q.*", "source_rank", "source_size", "target"), "mix-queue")

    def finish(epoch):
        served = epoch * F.col("source_size") + F.col("cum")
        return F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0) + epoch)

    copies = (queued.filter("size > 0")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .select(F.lit(0).alias("all"), finish(F.col("epoch")).alias("vft"), "source_rank", "pos",
                      "epoch", "size"))
    order = ["vft", "source_rank", "pos", "epoch"]
    spent = ordered_window(copies, ["all"], order, running_sums={"spent": "size"})
    total = (rows.agg(F.sum("size")).first()[0] or 0) * budget
    cut = spent.filter(F.col("spent") > total).agg(F.min(F.struct(*order, "spent", "size")).alias("c")).first()["c"]
    last = cut is not None and cut["spent"] - total < total - (cut["spent"] - cut["size"])  # nearer with it

    def is_taken(epoch):
        if cut is None:
            return F.lit(True)
        here = F.struct(finish(F.lit(epoch)).alias("vft"), "source_rank", "pos", F.lit(epoch).alias("epoch"))
        there = F.struct(*[F.lit(cut[c]).cast(spent.schema[c].dataType).alias(c) for c in order])
        return here <= there if last else here < there

    n = sum((is_taken(e).cast("int") for e in range(max_epochs)), F.lit(0))
    return (queued.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(n))
            .withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint"))
            .drop("cum", "source_rank"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float = 1.0,
        seed: int = SEED) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken."""
    keys = ["doc_id", "source", "h"]
    plan = mix_plan(docs, weights, max_epochs, budget, seed).filter("copies > 0")
    # Rows with the same id, source and text are interchangeable, so they are
    # numbered on both sides and meet one to one.
    nth = Window.partitionBy(*keys).orderBy("copies")
    plan = plan.withColumn("_nth", F.row_number().over(nth)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_nth", "copies")
    right = docs.select(F.struct(*docs.columns).alias("_row"), *keys[:2],
                        shuffle_key(seed).alias("h"))
    right = right.withColumn("_nth2", F.row_number().over(Window.partitionBy(*keys).orderBy("h")))
    cond = F.col("_nth") == F.col("_nth2")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (right.join(plan, cond)
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
            .select("_row.*"))


def op10_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op10_weighted_fair_mix": op10_weighted_fair_mix}
ORACLES = {"op10_weighted_fair_mix": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
  FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(source_rank - 1) % 3 + 1] AS weight, {MAX_EPOCHS} * source_size::DOUBLE AS cap FROM s),
o AS (  -- sources in the order in which the rising level caps them
  SELECT *, cap / weight AS capped_at,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - used) / free AS level FROM o),
l AS (SELECT coalesce(first(level ORDER BY capped_at, source_rank) FILTER (level <= capped_at), max(capped_at)) AS level FROM f),
t AS (SELECT w.*, least(cap, weight * level) AS target FROM w, l),
q AS (
  SELECT d.doc_id, d.source, d.size, d.h, t.source_size, t.target, t.source_rank,
         row_number() OVER own AS pos, sum(d.size) OVER (own ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW own AS (PARTITION BY d.source ORDER BY d.h, d.doc_id)),
c AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + cum)::DOUBLE / target AS vft
  FROM q, (SELECT unnest(range({MAX_EPOCHS})) AS epoch) e WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY vft, source_rank, pos, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM c),
b AS (SELECT sum(size) AS total FROM d),
k AS (SELECT doc_id, source, h, pos, count(*) AS copies FROM r, b
      WHERE spent <= total OR spent - size < total AND spent - total < total - (spent - size) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.copies, 0) * q.size)::BIGINT AS taken, q.source,
       CASE WHEN q.size = 0 THEN 1 ELSE coalesce(k.copies, 0) END::INTEGER AS copies
FROM q LEFT JOIN k ON k.source IS NOT DISTINCT FROM q.source AND k.pos = q.pos"""}
