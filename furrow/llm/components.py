"""Connected components by alternating large and small stars.

Every round is two grouped minima and two joins over the edges; a round links
each node to smaller ones until every component is a star around its smallest
node. Rounds grow with the logarithm of a component's diameter. Edges are
written to the shared checkpoint folder each round, so lineage stays short.
Hot nodes meet only partial minima and joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import release, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of comparable ids -> (node, root), the smallest node of
    each component; nodes without an edge to another node have no row. The
    result is a written table (``release`` it); those of the rounds are gone."""
    edges = staged(edges.select("u", "v").filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    seen = None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == seen:
            break
        seen = (n, total)
        both = _both(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # every u has larger ends only, so its smaller neighbours meet here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        ends = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        closer = staged(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                        "components")
        release(edges)
        edges = closer
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = staged(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    release(edges)
    return out
