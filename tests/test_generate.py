"""Generators (G1-G10): ranges, enumerations, nulls, uniqueness, partition independence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from furrow.sources import generate as G
from furrow.sources import schemas as S


def test_batch_plan():
    assert G.batch_plan(25, 10) == [10, 10, 5]
    assert G.batch_plan(20, 10) == [10, 10]
    assert G.batch_plan(0, 10) == []
    with pytest.raises(ValueError):
        G.batch_plan(10, 0)


def test_bad_range_rejected(spark):
    with pytest.raises(ValueError):
        G.generate(spark, "contacts", 10, start="2024-02-01", end="2024-01-01")
    with pytest.raises(ValueError):
        G.generate(spark, "contacts", -1)


def test_dates_in_range(spark):
    df = G.generate(spark, "contacts", 500, start="2024-01-01", end="2024-01-31")
    r = df.agg(F.min("created_at"), F.max("created_at"), F.max("updated_at")).first()
    assert r[0] >= dt.datetime(2024, 1, 1) and r[1] <= dt.datetime(2024, 1, 31)
    assert r[2] <= dt.datetime(2024, 1, 31) + dt.timedelta(days=30)


@pytest.mark.parametrize("name", list(S.SCHEMAS))
def test_every_schema_generates(spark, name):
    df = G.generate(spark, name, 300, start="2024-01-01", end="2024-12-31")
    assert df.count() == 300
    s = S.get_schema(name)
    assert df.columns == ["row_id"] + [f.name for f in s.generated_fields()]
    for f in s.generated_fields():
        assert df.schema[f.name].dataType == f.spark_type, f.name
    for u in s.unique_fields():
        assert df.select(u).distinct().count() == 300


def test_enumerations_and_bounds(spark):
    df = G.generate(spark, "sales_orders", 2000, start="2024-01-01", end="2024-12-31")
    got = {r[0] for r in df.select("status").distinct().collect()}
    assert got == set(S.ORDER_STATUS)
    r = df.agg(F.min("subtotal"), F.max("subtotal"), F.avg(F.col("ship_date").isNull().cast("int"))).first()
    assert float(r[0]) >= 10 and float(r[1]) <= 1000
    assert 0.15 < r[2] < 0.25   # G4: p = 0.2
    wc = G.generate(spark, "manufacturing_orders", 500).select("work_center").distinct().collect()
    assert all(x[0].startswith("WC-") and 1 <= int(x[0][3:]) <= 20 for x in wc)


def test_same_rows_for_any_partitioning(spark):
    a = G.generate(spark, "invoices", 700, rows_per_partition=700, start="2024-01-01", end="2024-06-30")
    b = G.generate(spark, "invoices", 700, rows_per_partition=100, start="2024-01-01", end="2024-06-30")
    assert a.rdd.getNumPartitions() != b.rdd.getNumPartitions()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_line_items_parse(spark):
    from furrow.operators.nested import explode_line_items
    inv = G.generate(spark, "invoices", 200, start="2024-01-01", end="2024-12-31")
    items = explode_line_items(inv, "row_id", "line_items_json")
    per = items.groupBy("row_id").count().agg(F.min("count"), F.max("count")).first()
    assert per[0] >= 1 and per[1] <= 5
    q = items.agg(F.min("quantity"), F.max("quantity"), F.min("unit_price"), F.max("unit_price")).first()
    assert q[0] >= 1 and q[1] <= 10 and float(q[2]) >= 10 and float(q[3]) <= 500


def test_field_overrides(spark):
    df = G.generate(spark, "sales_orders", 50, start="2024-01-01", end="2024-12-31",
                    overrides={"status": F.lit("pending"), "total": "subtotal + tax + shipping"})
    assert {r.status for r in df.select("status").distinct().collect()} == {"pending"}
    assert df.where("total != subtotal + tax + shipping").count() == 0
    assert df.schema["total"].dataType.simpleString() == "decimal(12,2)"
    with pytest.raises(ValueError):
        G.generate(spark, "contacts", 5, overrides={"nope": F.lit(1)})


def test_batches_as_rows(spark):
    from furrow.sources.generate import batch_plan, batches
    for total, size in ((25, 10), (30, 10), (1, 10), (0, 10), (-3, 10), (7, 1)):
        rows = batches(spark, total, size).orderBy("batch_no").collect()
        assert [r.rows for r in rows] == batch_plan(total, size) and [r.batch_no for r in rows] == list(range(len(rows)))
