"""The seed pipeline end to end: generate -> (normalise) -> load -> report.

Flat load: generate ``count`` rows, insert-ignore them on the schema's unique
key (plain append for the search flavour), ids from ``max(id)``. Normalised
load (relational flavours only; the search flavour falls back to flat with a
warning): dimensions are merged into ``dim_customer`` / ``dim_product`` first,
then the fact rows are written with foreign keys into ``<table>_normalized``,
looked up in the *merged* dimensions. ``clear`` drops the fact table (and the
dimensions when normalising) before loading.

Everything is distributed: generation is a narrow projection over
``spark.range``, loads are Spark appends. ``batch_size`` is how many rows one generation partition holds; it
never loops on the driver. A further run adds rows: row numbers go on after
those that the table was offered before, so business keys do not repeat.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from furrow.operators import normalize as N
from furrow.operators.sink import Store
from furrow.session import GENERATION_CONF, conf_scope
from furrow.sources.flavours import get_flavour, resolve_normalize
from furrow.sources.generate import generate
from furrow.sources.schemas import get_schema


def seed(spark: SparkSession, root: str, backend: str, schema_name: str, count: int,
         batch_size: int = 100_000, start=None, end=None, normalize: bool = False,
         clear: bool = False, seed_value: int = 42, id_mode: str = "dense") -> dict:
    """Run one seed load; returns the load report. ``id_mode="sequence"``
    numbers ids like the stores' sequences (skipped rows leave gaps)."""
    with conf_scope(spark, GENERATION_CONF):
        return _seed(spark, root, backend, schema_name, count, batch_size, start, end,
                     normalize, clear, seed_value, id_mode)


def _seed(spark, root, backend, schema_name, count, batch_size, start, end, normalize, clear,
          seed_value, id_mode) -> dict:
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    if count < 0:
        raise ValueError("count must be >= 0")
    schema = get_schema(schema_name)
    flavour = get_flavour(backend)
    normalize, warning = resolve_normalize(flavour, normalize)
    store = Store(spark, root, flavour.name, id_mode)
    table = f"{schema.table}_normalized" if normalize else schema.table
    if clear:
        store.drop(table)
        if normalize:
            store.drop(N.CUSTOMER_DIM)
            store.drop(N.PRODUCT_DIM)

    rows = generate(spark, schema_name, count, seed_value, start, end,
                    rows_per_partition=batch_size, first_row=store.offered(table))
    unique = schema.unique_fields()
    report = {"table": table, "offered": count, "normalized": normalize, "warning": warning}

    if not normalize:
        store.create_if_absent(table, schema.struct())
        loaded = _insert(store, table, rows, unique, count)
        report.update(inserted=loaded["inserted"], total=loaded["total"])
        return report

    dims = {}
    if schema_name in N.CUSTOMER_SCHEMAS:
        dims["customers"] = _merge_dim(store, N.CUSTOMER_DIM, N.customer_candidates(rows, "row_id"),
                                       "email", "id bigint, name string, email string, phone string")
    if schema_name in N.PRODUCT_SCHEMAS:
        dims["products"] = _merge_dim(store, N.PRODUCT_DIM, N.product_candidates(rows, "row_id"),
                                      "sku", "id bigint, sku string, name string")
    fact = N.normalize_facts(rows, schema_name, dims.get("customers"), dims.get("products"))
    fk = [c for c in fact.columns if c in ("customer_id", "product_id")]
    fact_schema = _fact_struct(schema, fk)
    store.create_if_absent(table, fact_schema)
    loaded = _insert(store, table, fact, unique, count)
    report.update(inserted=loaded["inserted"], total=loaded["total"],
                  customers=store.count(N.CUSTOMER_DIM) if "customers" in dims else None,
                  products=store.count(N.PRODUCT_DIM) if "products" in dims else None)
    return report


def _insert(store: Store, table: str, rows, unique: list[str], offered: int) -> dict:
    """Insert-ignore on the unique key in arrival (row_id) order, ids from max(id)."""
    return store.insert(table, rows, unique_key=unique or None, order_cols=["row_id"], id_col="id", offered=offered)


def _merge_dim(store: Store, name: str, candidates, key: str, ddl: str):
    from pyspark.sql.types import StructType
    store.create_if_absent(name, StructType.fromDDL(ddl))
    store.insert(name, N.new_members(store.read(name), candidates, key, store.max_id(name)), unique_key=[key])
    return store.read(name)


def _fact_struct(schema, fk: list[str]):
    from pyspark.sql.types import LongType, StructField, StructType
    drop = set(N.CUSTOMER_FIELDS) | set(N.PRODUCT_FIELDS) if fk else set()
    fields = [f.struct_field() for f in schema.fields if f.name not in drop]
    return StructType(fields + [StructField(c, LongType(), True) for c in fk])


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="furrow-seed", description="Seed a table store with generated rows")
    p.add_argument("--root", required=True, help="table store folder (shared storage on a cluster)")
    p.add_argument("-d", "--db", default="duckdb", help="store flavour: postgres, mysql, duckdb, elasticsearch")
    p.add_argument("-t", "--type", default="contacts", help="schema name")
    p.add_argument("-n", "--count", type=int, default=1000)
    p.add_argument("-b", "--batch-size", type=int, default=100_000)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--normalize", action="store_true")
    p.add_argument("--clear", action="store_true")
    p.add_argument("--id-mode", default="dense", choices=["dense", "sequence"])
    a = p.parse_args(argv)
    from furrow.session import build_session
    spark = build_session()
    print(json.dumps(seed(spark, a.root, a.db, a.type, a.count, a.batch_size, a.start, a.end,
                          a.normalize, a.clear, id_mode=a.id_mode), default=str))


if __name__ == "__main__":
    main()
