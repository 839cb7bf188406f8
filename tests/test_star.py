"""The declared star, its rollups and their sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from furrow.operators.metrics import Measure
from furrow.operators.sink import Store
from furrow.operators.star import Key, Lattice, Rollup, Star, names_in
from furrow.plans.star_pack import sales

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    rng = random.Random(2)
    facts = [(i, rng.choice([1, 2, 3, 9, None]), rng.choice(["x", "y"]), rng.choice([1.0, 2.5, None]),
              dt.datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), 5)) for i in range(500)]
    tables = {"f": spark.createDataFrame(facts, "f_id int, f_shop int, f_kind string, f_price double, f_at timestamp_ntz"),
              "shop": spark.createDataFrame([(1, 10, "north"), (2, 10, "south"), (3, 77, "lost")], "s_id int, s_town int, s_name string"),
              "town": spark.createDataFrame([(10, "A"), (11, "B")], "t_id int, t_name string")}
    measures = {m.name: m for m in (Measure("n", "count"), Measure("total", "sum", "f_price"), Measure("mean", "avg", "f_price"),
                                    Measure("low", "min", "f_price"), Measure("kinds", "count_distinct", "f_kind"),
                                    Measure("ids", "approx_distinct", "f_id"), Measure("mid", "approx_quantile", ("f_id", 0.5)),
                                    Measure("share", "ratio", ("f_price", "f_id")))}
    return Star("f", tables, [Key("f", "f_shop", "shop", "s_id"), Key("shop", "s_town", "town", "t_id")], measures,
                {"kind": "f_kind", "shop": "s_name", "town": "t_name", "first": "substr(t_name, 1, 1)"}, "f_at")


def plain(star):
    """The whole star joined by hand."""
    t = star.tables
    return (t["f"].join(t["shop"], F.col("f_shop") == F.col("s_id"), "left").join(t["town"], F.col("s_town") == F.col("t_id"), "left"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_only_needed_tables_are_scanned(spark):
    s = sales(spark, SF)

    def scans(*a, **b):
        s.query(*a, **b).collect()
        plan = s.query(*a, **b)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("parquet")

    assert scans(["lines"], ["flag"]) == 1
    assert scans(["revenue"], ["status"]) == 2
    assert scans(["revenue"], [], "month") == 2
    assert scans(["revenue"], ["flag"], None, ["region = 'ASIA'"]) == 5
    assert scans(["customers"], ["flag"]) == 2
    assert scans(["revenue"], ["region", "brand"]) == 6


def test_facts_without_a_match_stay(star):
    got = rows(star.query(["n", "total"], ["town"]))
    want = rows(plain(star).groupBy("t_name").agg(F.count(F.lit(1)), F.sum("f_price")))
    assert got == want and any(r[0] is None for r in got)
    assert sum(r[1] for r in got) == star.tables["f"].count()


def test_early_aggregation_changes_nothing(star):
    p = plain(star)
    got = {tuple(r)[:2]: r for r in star.query(["n", "total", "mean", "low", "share"], ["kind", "first"], "month", ["shop <> 'it''s x'"]).collect()}
    want = p.where("s_name <> 'it''s x'").groupBy(F.col("f_kind"), F.expr("substr(t_name, 1, 1)"), F.trunc("f_at", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f_price").alias("total"), F.avg("f_price").alias("mean"), F.min("f_price").alias("low"),
        (F.sum("f_price") / F.sum("f_id")).alias("share")).collect()
    got = {(r["kind"], r["first"], r["month"]): r for r in star.query(
        ["n", "total", "mean", "low", "share"], ["kind", "first"], "month", ["shop <> 'it''s x'"]).collect()}
    assert len(got) == len(want)
    for r in want:
        g = got[r[0], r[1], r["month"]]
        assert (g["n"], g["low"]) == (r["n"], r["low"])
        assert g["total"] == pytest.approx(r["total"]) and g["mean"] == pytest.approx(r["mean"]) and g["share"] == pytest.approx(r["share"])
    assert rows(star.query(["kinds"], ["town"])) == rows(p.groupBy("t_name").agg(F.count_distinct("f_kind")))


def test_declarations_are_checked(spark, star):
    with pytest.raises(ValueError, match="no declared key"):
        Star("f", star.tables, star.keys[:1], star.measures, star.dimensions, "f_at").query(["n"], ["town"])
    with pytest.raises(ValueError, match="rename one"):
        Star("f", {**star.tables, "again": star.tables["town"]}, star.keys, star.measures, star.dimensions)
    with pytest.raises(ValueError, match="no kind"):
        Measure("x", "median", "f_id")
    assert names_in("a = 'b c' and lower(d) <> 'it''s'") == {"a", "and", "lower", "d"}


@pytest.fixture(scope="module")
def lattice(spark, star, tmp_path_factory):
    every = ("n", "total", "mean", "low", "share", "ids", "mid")
    return Lattice(star, Store(spark, str(tmp_path_factory.mktemp("rollups"))), [
        Rollup("fine", every, ("kind", "shop", "town"), "day"), Rollup("monthly", every, ("kind", "town"), "month"),
        Rollup("yearly", ("n", "total"), ("town",), "year"), Rollup("kinds", every, ("kind",))]).build()


CASES = [(["n"], ["town"], None, [], None, "yearly"), (["n"], ["town"], "year", [], None, "yearly"),
         (["n", "total"], ["town"], "month", [], None, "monthly"), (["n", "mean"], ["kind"], None, [], None, "kinds"),
         (["n"], [], None, ["kind = 'x' and town = 'A'"], None, "monthly"), (["low"], ["shop"], "week", [], None, "fine"),
         (["n"], ["kind"], None, [], ("2024-03-01", "2024-06-01"), "monthly"), (["n"], ["kind"], None, [], ("2024-03-05", "2024-06-01"), "fine"),
         (["n"], ["kind"], None, [], ("2024-03-05 06:00:00", "2024-06-01"), "f"), (["n"], ["town"], None, [], ("2024-01-01", "2025-01-01"), "yearly"),
         (["n"], ["first"], None, [], None, "f"), (["kinds"], ["town"], None, [], None, "f"), (["n"], ["kind"], "hour", [], None, "f"),
         (["n"], ["kind"], None, ["f_price > 1"], None, "f"), (["n"], [], None, ["shop = 'north'"], ("2024-02-01", "2024-03-01"), "fine")]


@pytest.mark.parametrize("measures,dimensions,granularity,filters,between,source", CASES)
def test_answers_from_the_smallest_cover(lattice, star, measures, dimensions, granularity, filters, between, source):
    asked = (measures, dimensions, granularity, filters, between)
    assert lattice.source(*asked) == source
    got, want = rows(lattice.answer(*asked)), rows(star.query(*asked))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or a == pytest.approx(b) for a, b in zip(g, w))


def test_merged_sketches_keep_their_error_bounds(lattice, star):
    assert lattice.source(["ids", "mid"], ["town"]) == "monthly"
    exact = {r[0]: sorted(x for x in r[1]) for r in plain(star).groupBy("t_name").agg(F.collect_list("f_id")).collect()}
    for r in lattice.answer(["ids", "mid"], ["town"]).collect():
        ids = exact[r["town"]]
        assert abs(r["ids"] - len(ids)) <= 0.03 * len(ids)
        rank = sum(x <= r["mid"] for x in ids) / len(ids)
        assert abs(rank - 0.5) <= 0.02 + 1 / len(ids)
    with pytest.raises(ValueError, match="cannot be pre-aggregated"):
        star.measures["kinds"].parts()
