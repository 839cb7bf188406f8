"""Registered queries of the declared star, its rollups and their sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.metrics import Measure
from furrow.operators.sink import Store
from furrow.operators.star import Key, Lattice, Rollup, Star
from furrow.session import scratch_path
from furrow.sources.tables import load

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")
KEYS = [Key("lineitem", "l_orderkey", "orders", "o_orderkey"), Key("lineitem", "l_partkey", "part", "p_partkey"),
        Key("lineitem", "l_suppkey", "supplier", "s_suppkey"), Key("orders", "o_custkey", "customer", "c_custkey"),
        Key("customer", "c_nationkey", "nation", "n_nationkey"), Key("nation", "n_regionkey", "region", "r_regionkey")]
MEASURES = {m.name: m for m in (
    Measure("revenue", "sum", "cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2)))"),
    Measure("lines", "count"), Measure("quantity", "sum", "cast(l_quantity as decimal(15,2))"),
    Measure("least", "min", "l_quantity"), Measure("most", "max", "l_quantity"),
    Measure("customers", "count_distinct", "o_custkey"), Measure("about_customers", "approx_distinct", "o_custkey"),
    Measure("about_median", "approx_quantile", ("l_extendedprice", 0.5)))}
DIMENSIONS = {"region": "r_name", "nation": "n_name", "status": "o_orderstatus", "flag": "l_returnflag", "brand": "p_brand"}


def sales(spark: SparkSession, sf: str) -> Star:
    return Star("lineitem", {t: load(spark, sf, t) for t in TABLES}, KEYS, MEASURES, DIMENSIONS, "o_orderdate")


def _money(c: str):
    return F.round(c, 2).cast("decimal(18,2)").alias(c)


def star_by_status_month(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables are enough: lineitem and orders."""
    q = sales(spark, sf).query(["revenue", "lines", "least", "most"], ["status"], "month", ["flag <> 'N'"])
    return q.select("status", "month", _money("revenue"), "lines", "least", "most")


def star_by_region_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms of the star, a filter on a third column, an exact distinct count."""
    q = sales(spark, sf).query(["revenue", "customers"], ["region", "brand"], None, ["nation NOT IN ('CHINA', 'FRANCE')"],
                               ("1995-01-01", "1997-07-01"))
    return q.select("region", "brand", _money("revenue"), F.col("customers").cast("bigint").alias("customers"))


def _lattice(spark: SparkSession, sf: str) -> Lattice:
    return Lattice(sales(spark, sf), Store(spark, scratch_path(spark, "rollups")), [
        Rollup("by_nation_status_month", ("revenue", "lines", "quantity"), ("region", "nation", "status"), "month"),
        Rollup("by_region_month", ("revenue", "lines"), ("region",), "month"),
        Rollup("by_region_year", ("revenue", "lines"), ("region",), "year"),
        Rollup("by_status", ("revenue", "lines"), ("status",))]).build()


QUESTIONS = [  # name, dimension, granularity, filters, between
    ("regions", "region", None, [], None),
    ("regions in the nineties", "region", None, [], ("1993-01-01", "1996-01-01")),
    ("regions in a quarter", "region", None, [], ("1995-04-01", "1995-07-01")),
    ("regions of finished orders", "region", None, ["status = 'F'"], None),
    ("statuses", "status", None, [], None),
    ("nations from mid-month on", "nation", None, [], ("1996-03-15", "1998-01-01")),
    ("brands", "brand", None, ["region = 'ASIA'"], None),
]


def rollup_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with filters, each answered from the smallest rollup that
    covers it, or from the star."""
    lattice, out = _lattice(spark, sf), None
    for name, dimension, granularity, filters, between in QUESTIONS:
        asked = (["revenue", "lines"], [dimension], granularity, filters, between)
        a = lattice.answer(*asked).select(F.lit(name).alias("question"), F.lit(lattice.source(*asked)).alias("source"),
                                          F.col(dimension).alias("key"), _money("revenue"), F.col("lines").cast("bigint").alias("lines"))
        out = a if out is None else out.unionByName(a)
    return out


def rollup_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct customers and the median price by region, from the merged
    sketches of a nation x month rollup, beside the exact figures: the estimate
    is within 3 % of the count, the median's rank within 2 % of the middle."""
    star = sales(spark, sf)
    lattice = Lattice(star, Store(spark, scratch_path(spark, "sketches")), [
        Rollup("by_nation_month", ("about_customers", "about_median"), ("region", "nation"), "month")]).build()
    about = lattice.answer(["about_customers", "about_median"], ["region"])
    rows = star._join({"r_name", "o_custkey", "l_extendedprice"}, star.tables["lineitem"])
    ranks = rows.withColumnRenamed("r_name", "region").join(about, "region").groupBy("region").agg(
        F.count_distinct("o_custkey").alias("customers"), F.first("about_customers").alias("about_customers"),
        F.avg((F.col("l_extendedprice") < F.col("about_median")).cast("double")).alias("below"),
        F.avg((F.col("l_extendedprice") <= F.col("about_median")).cast("double")).alias("up_to"))
    return ranks.select("region", F.col("customers").cast("bigint").alias("customers"),
                        (F.abs(F.col("about_customers") - F.col("customers")) <= 0.03 * F.col("customers")).alias("count_is_close"),
                        ((F.col("below") <= 0.52) & (F.col("up_to") >= 0.48)).alias("median_is_close"))


QUERIES = {
    "star_by_status_month": star_by_status_month,
    "star_by_region_brand": star_by_region_brand,
    "rollup_lattice": rollup_lattice,
    "rollup_sketches": rollup_sketches,
}

_ALL = """star AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS rev
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
_SOURCES = {"regions": ("by_region_year", "r_name", "true"),
            "regions in the nineties": ("by_region_year", "r_name", "o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
            "regions in a quarter": ("by_region_month", "r_name", "o_orderdate >= TIMESTAMP '1995-04-01' AND o_orderdate < TIMESTAMP '1995-07-01'"),
            "regions of finished orders": ("by_nation_status_month", "r_name", "o_orderstatus = 'F'"),
            "statuses": ("by_status", "o_orderstatus", "true"),
            "nations from mid-month on": ("lineitem", "n_name", "o_orderdate >= TIMESTAMP '1996-03-15' AND o_orderdate < TIMESTAMP '1998-01-01'"),
            "brands": ("lineitem", "p_brand", "r_name = 'ASIA'")}

ORACLES = {
    "star_by_status_month": f"""WITH {_ALL}
        SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue, count(*) AS lines, min(l_quantity) AS least, max(l_quantity) AS most
        FROM star WHERE l_returnflag <> 'N' GROUP BY 1, 2""",
    "star_by_region_brand": f"""WITH {_ALL}
        SELECT r_name AS region, p_brand AS brand, CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue,
               count(DISTINCT o_custkey) AS customers
        FROM star WHERE n_name NOT IN ('CHINA', 'FRANCE') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'
        GROUP BY 1, 2""",
    "rollup_lattice": f"WITH {_ALL} " + " UNION ALL ".join(
        f"""SELECT '{name}' AS question, '{source}' AS source, {key} AS key, CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue,
            count(*) AS lines FROM star WHERE {where} GROUP BY {key}""" for name, (source, key, where) in _SOURCES.items()),
    "rollup_sketches": f"""WITH {_ALL}
        SELECT r_name AS region, count(DISTINCT o_custkey) AS customers, true AS count_is_close, true AS median_is_close
        FROM star GROUP BY 1""",
}
