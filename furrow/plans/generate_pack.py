"""Registered generation queries (G1-G10, R10). Each generated table is driven
by the keys of a provided table, so its size grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.ids import dense_ids
from furrow.operators.nested import line_item_totals
from furrow.session import materialize
from furrow.sources import generate as G
from furrow.sources.tables import load

START, END, SEED = "2024-01-01", "2024-12-31", 42
BATCH = 1000

# schema -> (table, key column) whose rows drive the generator
DRIVERS = {
    "contacts": ("customer", "c_custkey"),
    "sales_orders": ("orders", "o_orderkey"),
    "manufacturing_orders": ("events", "event_id"),
    "products": ("part", "p_partkey"),
    "invoices": ("orders", "o_orderkey"),
}


def generated(spark: SparkSession, sf: str, schema: str) -> DataFrame:
    """A generated row costs far more than its key, and a file of keys may be a
    single split: the keys are dealt out and written down before rows are made
    of them (a filter on the rows would move below a mere repartition)."""
    table, key = DRIVERS[schema]
    ids = load(spark, sf, table).select(F.col(key).alias("row_id"))
    dealt = materialize(ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return G.generate_for(spark, schema, dealt, SEED, START, END)


def _gen_query(schema: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return generated(spark, sf, schema)
    q.__name__ = f"gen_{schema}"
    return q


def gen_batch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders split into insert batches of 1,000 in arrival order; a batch
    shows if it holds as many rows as planned."""
    o = load(spark, sf, "orders").select("o_orderkey")
    numbered = dense_ids(o, ["o_orderkey"], id_col="pos")
    found = (numbered.groupBy(F.floor((F.col("pos") - 1) / BATCH).cast("bigint").alias("batch_no"))
             .agg(F.count(F.lit(1)).alias("rows")))
    return found.join(G.batches(spark, o.count(), BATCH), ["batch_no", "rows"])


def invoice_line_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Parse the generated invoices' JSON line items and total them."""
    return line_item_totals(generated(spark, sf, "invoices"), "row_id", "line_items_json")


def _oracle_gen(schema: str) -> str:
    table, key = DRIVERS[schema]
    return G.oracle_sql(schema, f"SELECT {key} AS row_id FROM {table}", SEED, START, END)


QUERIES = {f"gen_{s}": _gen_query(s) for s in DRIVERS}
QUERIES["gen_batch_sizes"] = gen_batch_sizes
QUERIES["invoice_line_totals"] = invoice_line_totals

ORACLES = {f"gen_{s}": _oracle_gen(s) for s in DRIVERS}
ORACLES["gen_batch_sizes"] = f"""
    SELECT CAST(floor((pos - 1) / {BATCH}) AS BIGINT) AS batch_no, count(*) AS rows
    FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) GROUP BY 1"""
ORACLES["invoice_line_totals"] = f"""
    WITH inv AS ({_oracle_gen('invoices')}),
    items AS (
      SELECT row_id, unnest(from_json(line_items_json,
               '[{{"description":"VARCHAR","quantity":"INTEGER","unit_price":"DECIMAL(12,2)"}}]')) AS it
      FROM inv)
    SELECT row_id, CAST(count(*) AS BIGINT) AS items,
           CAST(sum(it.quantity) AS BIGINT) AS quantity,
           CAST(sum(it.quantity * it.unit_price) AS DECIMAL(18,2)) AS line_total
    FROM items GROUP BY row_id"""

