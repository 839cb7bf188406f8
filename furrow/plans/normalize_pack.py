"""Registered queries for normalisation (N1-N6) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import normalize as N
from furrow.sources import feeds

# ---------------------------------------------------------------- queries


def norm_customer_dim(spark: SparkSession, sf: str) -> DataFrame:
    return N.customer_dimension(feeds.orders_feed(spark, sf), "o_orderkey")


def norm_product_dim(spark: SparkSession, sf: str) -> DataFrame:
    return N.product_dimension(feeds.parts_feed(spark, sf), "p_partkey")


def norm_orders_fact(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize(feeds.orders_feed(spark, sf), "sales_orders", "o_orderkey").fact


def norm_parts_fact(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize(feeds.parts_feed(spark, sf), "manufacturing_orders", "p_partkey").fact


def norm_null_key_fact(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize(feeds.orders_feed_with_gaps(spark, sf), "sales_orders", "o_orderkey").fact


def norm_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """A schema without entities (``contacts``) comes back unchanged."""
    from furrow.sources.generate import generate_for
    contacts = generate_for(spark, "contacts", feeds.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id")))
    return N.normalize(contacts, "contacts", "row_id").fact


def dim_merge(spark: SparkSession, sf: str) -> DataFrame:
    """First run loads orders with o_orderkey below half the key range,
    the second run the rest; ids must equal a one-shot run."""
    f = feeds.orders_feed(spark, sf)
    half = _half_key(spark, sf)
    first = N.customer_dimension(f.where(F.col("o_orderkey") < half), "o_orderkey")
    second = N.customer_candidates(f.where(F.col("o_orderkey") >= half), "o_orderkey")
    return N.merge_dimension(first, second, "email")


def _half_key(spark: SparkSession, sf: str) -> int:
    o = feeds.load(spark, sf, "orders")
    return int(o.agg(F.max("o_orderkey")).first()[0] + 1) // 2


def seed_normalized_report(spark: SparkSession, sf: str) -> DataFrame:
    """N6 + K8: entity and fact counts of one normalised load, one row per metric."""
    res = N.normalize(feeds.orders_feed(spark, sf), "sales_orders", "o_orderkey")
    facts = res.fact.agg(F.count(F.lit(1)).alias("facts_offered"),
                         F.count("customer_id").alias("facts_with_fk"))
    dims = res.customers.agg(F.count(F.lit(1)).alias("customers_created"),
                             F.max("id").alias("max_customer_id"))
    return _metrics(facts).unionByName(_metrics(dims))


def _metrics(one_row: DataFrame) -> DataFrame:
    """Turn a one-row aggregate into (metric, value) rows."""
    return one_row.unpivot([], one_row.columns, "metric", "value").select(
        "metric", F.col("value").cast("bigint").alias("value"))


# ---------------------------------------------------------------- oracles


def _gen_oracle(schema: str, source: str) -> str:
    from furrow.sources.generate import oracle_sql
    return oracle_sql(schema, source, 42, "2024-01-01", "2024-12-31")


F1 = """f1 AS (
  SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         c.c_name AS customer_name,
         lower(replace(c.c_name, '#', '.')) || '@example.com' AS customer_email
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

F2 = """f2 AS (
  SELECT p_partkey, p_brand, p_size, p_retailprice, p_type AS product_name, p_name AS product_sku
  FROM part)"""

F3 = F1 + """, f3 AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, customer_name,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' ELSE customer_email END
           AS customer_email
  FROM f1)"""

CUST_DIM = """cdim AS (
  SELECT CAST(row_number() OVER (ORDER BY first_seq, email) AS BIGINT) AS id, name, email, phone
  FROM (SELECT customer_email AS email, first(customer_name ORDER BY o_orderkey) AS name,
               '' AS phone, min(o_orderkey) AS first_seq
        FROM {feed} WHERE customer_email IS NOT NULL AND customer_email <> '' GROUP BY customer_email))"""

PROD_DIM = """pdim AS (
  SELECT CAST(row_number() OVER (ORDER BY first_seq, sku) AS BIGINT) AS id, sku, name
  FROM (SELECT product_sku AS sku, first(product_name ORDER BY p_partkey) AS name, min(p_partkey) AS first_seq
        FROM f2 WHERE product_sku IS NOT NULL AND product_sku <> '' GROUP BY product_sku))"""

ORACLES = {
    "norm_customer_dim": f"WITH {F1}, {CUST_DIM.format(feed='f1')} SELECT * FROM cdim",
    "norm_product_dim": f"WITH {F2}, {PROD_DIM} SELECT * FROM pdim",
    "norm_orders_fact": f"""WITH {F1}, {CUST_DIM.format(feed='f1')}
        SELECT f1.o_orderkey, f1.o_orderstatus, f1.o_totalprice, f1.o_orderdate, f1.o_orderpriority,
               cdim.id AS customer_id
        FROM f1 LEFT JOIN cdim ON f1.customer_email = cdim.email""",
    "norm_parts_fact": f"""WITH {F2}, {PROD_DIM}
        SELECT f2.p_partkey, f2.p_brand, f2.p_size, f2.p_retailprice, pdim.id AS product_id
        FROM f2 LEFT JOIN pdim ON f2.product_sku = pdim.sku""",
    "norm_null_key_fact": f"""WITH {F3}, {CUST_DIM.format(feed='f3')}
        SELECT f3.o_orderkey, f3.o_orderstatus, f3.o_totalprice, f3.o_orderdate, f3.o_orderpriority,
               cdim.id AS customer_id
        FROM f3 LEFT JOIN cdim ON f3.customer_email = cdim.email""",
    "dim_merge": f"WITH {F1}, {CUST_DIM.format(feed='f1')} SELECT * FROM cdim",
    "norm_passthrough": _gen_oracle("contacts", "SELECT c_custkey AS row_id FROM customer"),
    "seed_normalized_report": f"""WITH {F1}, {CUST_DIM.format(feed='f1')},
        fact AS (SELECT cdim.id AS customer_id FROM f1 LEFT JOIN cdim ON f1.customer_email = cdim.email)
        SELECT 'facts_offered' AS metric, CAST(count(*) AS BIGINT) AS value FROM fact
        UNION ALL SELECT 'facts_with_fk', CAST(count(customer_id) AS BIGINT) FROM fact
        UNION ALL SELECT 'customers_created', CAST(count(*) AS BIGINT) FROM cdim
        UNION ALL SELECT 'max_customer_id', CAST(max(id) AS BIGINT) FROM cdim""",
}

QUERIES = {
    "norm_customer_dim": norm_customer_dim,
    "norm_product_dim": norm_product_dim,
    "norm_orders_fact": norm_orders_fact,
    "norm_parts_fact": norm_parts_fact,
    "norm_null_key_fact": norm_null_key_fact,
    "norm_passthrough": norm_passthrough,
    "dim_merge": dim_merge,
    "seed_normalized_report": seed_normalized_report,
}
