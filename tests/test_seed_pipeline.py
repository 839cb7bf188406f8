"""The seed pipeline end to end (generate -> normalise -> load -> report)."""

import tempfile

import pytest

from furrow.plans.seed import main, seed


def test_second_run_adds_rows_with_new_keys(spark):
    root = tempfile.mkdtemp(prefix="furrow-seed-")
    r1 = seed(spark, root, "duckdb", "sales_orders", 100, 50, "2024-01-01", "2024-12-31")
    assert (r1["inserted"], r1["total"]) == (100, 100)
    r2 = seed(spark, root, "duck", "sales_orders", 80, 50, "2024-01-01", "2024-12-31")
    assert (r2["inserted"], r2["total"]) == (80, 180)
    from furrow.operators.sink import Store
    t = Store(spark, root, "duckdb").read(r2["table"])
    assert t.select("order_number").distinct().count() == 180 and t.select("id").distinct().count() == 180


def test_search_flavour_appends_and_refuses_normalisation(spark):
    root = tempfile.mkdtemp(prefix="furrow-seed-es-")
    r = seed(spark, root, "es", "invoices", 40, 10, "2024-01-01", "2024-12-31", normalize=True)
    assert r["normalized"] is False and "flat" in r["warning"]
    r = seed(spark, root, "es", "invoices", 40, 10, "2024-01-01", "2024-12-31")
    assert r["total"] == 80


def test_normalised_load_and_clear(spark):
    from furrow.operators.sink import Store
    root = tempfile.mkdtemp(prefix="furrow-seed-n-")
    r = seed(spark, root, "postgres", "manufacturing_orders", 60, 20, "2024-01-01", "2024-12-31",
             normalize=True)
    assert r["table"] == "manufacturing_orders_normalized" and r["inserted"] == 60 and r["products"] == 60
    st = Store(spark, root, "postgres")
    fact = st.read("manufacturing_orders_normalized")
    assert "product_sku" not in fact.columns and fact.where("product_id IS NULL").count() == 0
    r = seed(spark, root, "postgres", "manufacturing_orders", 60, 20, "2024-01-01", "2024-12-31",
             normalize=True, clear=True)
    assert r["total"] == 60 and r["products"] == 60


def test_products_normalise_into_own_dimension(spark):
    root = tempfile.mkdtemp(prefix="furrow-seed-p-")
    r = seed(spark, root, "duckdb", "products", 30, 10, "2024-01-01", "2024-12-31", normalize=True)
    assert r["table"] == "products_normalized" and r["inserted"] == 30


def test_validation(spark):
    with pytest.raises(ValueError):
        seed(spark, tempfile.mkdtemp(), "duckdb", "contacts", 10, 0)
    with pytest.raises(ValueError):
        seed(spark, tempfile.mkdtemp(), "duckdb", "nope", 10, 10)
    with pytest.raises(ValueError):
        seed(spark, tempfile.mkdtemp(), "oracle", "contacts", 10, 10)
    with pytest.raises(ValueError):        # malformed date, as the CLI rejects it
        seed(spark, tempfile.mkdtemp(), "duckdb", "contacts", 10, 10, start="2024/01/01")
    with pytest.raises(ValueError):        # start after end
        seed(spark, tempfile.mkdtemp(), "duckdb", "contacts", 10, 10, "2024-02-01", "2024-01-01")


def test_cli(spark, capsys):
    main(["--root", tempfile.mkdtemp(prefix="furrow-cli-"), "-t", "contacts", "-n", "25", "-b", "10",
          "--start", "2024-01-01", "--end", "2024-01-31"])
    assert '"inserted": 25' in capsys.readouterr().out


def test_second_normalised_run_continues_dimension_ids(spark):
    from pyspark.sql import functions as F

    from furrow.operators.sink import Store
    root = tempfile.mkdtemp(prefix="furrow-seed-ids-")
    seed(spark, root, "duckdb", "manufacturing_orders", 40, 20, "2024-01-01", "2024-12-31",
         normalize=True, seed_value=1)
    seed(spark, root, "duckdb", "manufacturing_orders", 40, 20, "2024-01-01", "2024-12-31",
         normalize=True, seed_value=2)
    st = Store(spark, root, "duckdb")
    dim = st.read("dim_product")
    n, top, distinct = dim.agg(F.count("*"), F.max("id"), F.countDistinct("id")).first()
    assert n == top == distinct and st.max_id("dim_product") == top
    fact = st.read("manufacturing_orders_normalized")
    assert fact.join(dim, fact.product_id == dim.id, "left_anti").count() == 0
