"""Registered sink queries (K1-K10) over lineitem / orders / events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import conflicts as C
from furrow.operators import sink as K
from furrow.operators.rules import ForeignKey, check_constraints as check
from furrow.session import scratch_path
from furrow.sources.tables import load

LI_KEY = ["l_orderkey", "l_linenumber"]
LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]
LI_PART = ["l_partkey", "l_suppkey"]
CUTOFF = "1997-01-01"


def _lineitem(spark, sf):
    return load(spark, sf, "lineitem")


def _early(spark, sf) -> DataFrame:
    """The lines shipped before the cutoff."""
    return _lineitem(spark, sf).where(F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp_ntz"))


def _existing(spark, sf) -> DataFrame:
    """The table after a first load of the early lines."""
    return C.insert_ignore(None, _early(spark, sf), LI_KEY, LI_REST)


def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return C.insert_ignore(None, _lineitem(spark, sf), LI_KEY, LI_REST)


def insert_ignore_existing(spark: SparkSession, sf: str) -> DataFrame:
    existing = _existing(spark, sf)
    accepted = C.insert_ignore(existing, _lineitem(spark, sf), LI_KEY, LI_REST)
    return existing.unionByName(accepted)


def insert_ignore_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    """K2a with two unique keys, (order, line) and (part, supplier): a line that
    one key keeps out does not block later lines on the other."""
    return C.insert_ignore_any(None, _lineitem(spark, sf), [LI_KEY, LI_PART], LI_REST)


def insert_ignore_two_keys_existing(spark: SparkSession, sf: str) -> DataFrame:
    """The same load into a table that holds the lines of an earlier one."""
    existing = C.insert_ignore_any(None, _early(spark, sf), [LI_KEY, LI_PART], LI_REST)
    return C.insert_ignore_any(existing, _lineitem(spark, sf), [LI_KEY, LI_PART], LI_REST)


def seed_report(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the report of a second load, observed while it is written."""
    store = K.Store(spark, scratch_path(spark, "store-report"), "postgres")
    li = _lineitem(spark, sf)
    store.create_if_absent("lineitem", li.schema, unique=[LI_KEY])
    store.insert("lineitem", _early(spark, sf), order_cols=LI_REST)
    return K.load_report(spark, store.insert("lineitem", li, order_cols=LI_REST))


def load_with_rules(spark: SparkSession, sf: str) -> DataFrame:
    """K8 and K9 in the load's own job: orders offered twice, some without a
    priority (NOT NULL) and some of customers that the store lacks (FOREIGN
    KEY), counted while they are written."""
    store = K.Store(spark, scratch_path(spark, "store-rules"), "postgres")
    c = load(spark, sf, "customer")
    o = load(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    store.create_if_absent("customer", c.schema, unique=[["c_custkey"]])
    store.insert("customer", c.where("c_acctbal > 0"))
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != "o_orderpriority") for f in o.schema.fields])
    store.create_if_absent("orders", schema, unique=[["o_orderkey"]],
                           foreign_keys=[ForeignKey(("o_custkey",), "customer", ("c_custkey",))])
    return K.load_report(spark, store.insert("orders", o.unionByName(o), on_violation="report"))


def table_violations(spark: SparkSession, sf: str) -> DataFrame:
    """K9 by the rules that a stored table carries."""
    store = K.Store(spark, scratch_path(spark, "store-k9"), "es")
    s, li = load(spark, sf, "supplier").where("s_acctbal > 0"), _lineitem(spark, sf)
    store.create_if_absent("supplier", s.schema)
    store.insert("supplier", s)
    schema = T.StructType([T.StructField(f.name, f.dataType, f.name != "l_shipdate") for f in li.schema.fields])
    store.create_if_absent("lineitem", schema, unique=[LI_KEY], foreign_keys=[ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))])
    store.insert("lineitem", li, on_violation="report")
    return store.violations("lineitem")


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    accepted = C.insert_ignore(None, _lineitem(spark, sf), LI_KEY, LI_REST)
    return K.assign_ids(accepted, LI_KEY, 0)


def append_all(spark: SparkSession, sf: str) -> DataFrame:
    """Plain append into a search-flavour store keeps every offered row."""
    store = K.Store(spark, scratch_path(spark, "store-es"), "es")
    li = _lineitem(spark, sf)
    store.create_if_absent("lineitem", li.schema)
    store.insert("lineitem", li, unique_key=LI_KEY)
    return store.read("lineitem")


def create_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """K1: creating an existing table is a no-op and never clobbers its rows:
    create, create again, load orders, create once more, read back."""
    store = K.Store(spark, scratch_path(spark, "store-k1"), "postgres")
    o = load(spark, sf, "orders")
    if not store.create_if_absent("orders", o.schema) or store.create_if_absent("orders", o.schema):
        raise AssertionError("create_if_absent must create once")
    store.insert("orders", o, unique_key=["o_orderkey"],
                 order_cols=[c for c in o.columns if c != "o_orderkey"])
    if store.create_if_absent("orders", o.schema):
        raise AssertionError("create_if_absent recreated an existing table")
    return store.read("orders")


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """K1 + K2a + K4: create, load with insert-ignore, count per table."""
    store = K.Store(spark, scratch_path(spark, "store-duck"), "duckdb")
    loads = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": LI_KEY}
    for name, key in loads.items():
        df = load(spark, sf, name)
        store.create_if_absent(name, df.schema)
        rest = [c for c in df.columns if c not in key]
        store.insert(name, df, unique_key=key, order_cols=rest)
    out = None
    for n in loads:
        c = store.read(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def truncate_seconds(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("event_id", "ts")
    return K.truncate_seconds(ev, ["ts"])


def check_constraints(spark: SparkSession, sf: str) -> DataFrame:
    li = _lineitem(spark, sf)
    o = load(spark, sf, "orders")
    a = check(
        li, "lineitem", not_null=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        unique=[LI_KEY],
        foreign_keys=[(["l_orderkey"], o, ["o_orderkey"]),
                      (["l_partkey"], load(spark, sf, "part"), ["p_partkey"]),
                      (["l_suppkey"], load(spark, sf, "supplier"), ["s_suppkey"])])
    b = check(
        o, "orders", not_null=["o_orderkey", "o_custkey"], unique=[["o_orderkey"]],
        foreign_keys=[(["o_custkey"], load(spark, sf, "customer"), ["c_custkey"])])
    return a.unionByName(b)


def table_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K4-K6: row counts after load, truncate, reload, drop and a new load."""
    store = K.Store(spark, scratch_path(spark, "store-life"), "duckdb")
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    steps = []

    def note(step: str) -> None:
        steps.append((step, store.count("t")))

    store.create_if_absent("t", orders.schema)
    store.insert("t", orders)
    note("loaded")
    store.truncate("t")
    note("truncated")
    store.insert("t", orders.where("o_orderstatus = 'F'"))
    note("reloaded")
    store.drop("t")
    if store.exists("t"):
        raise AssertionError("a dropped table is still there")
    store.create_if_absent("t", customers.schema)
    store.insert("t", customers)
    note("recreated")
    return spark.createDataFrame(steps, "step string, n bigint")


QUERIES = {
    "table_lifecycle": table_lifecycle,
    "insert_ignore_two_keys": insert_ignore_two_keys,
    "insert_ignore_two_keys_existing": insert_ignore_two_keys_existing,
    "load_with_rules": load_with_rules,
    "table_violations": table_violations,
    "insert_ignore": insert_ignore,
    "insert_ignore_existing": insert_ignore_existing,
    "seed_report": seed_report,
    "assign_ids": assign_ids,
    "append_all": append_all,
    "create_if_absent": create_if_absent,
    "table_counts": table_counts,
    "truncate_seconds": truncate_seconds,
    "check_constraints": check_constraints,
}

_ORDER = ", ".join(LI_REST)
_FIRST = f"""SELECT * FROM {{src}}
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) = 1"""
_EXISTING = _FIRST.format(src=f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}')")
_NEW = _FIRST.format(src="""(SELECT * FROM lineitem l WHERE NOT EXISTS (
      SELECT 1 FROM ex WHERE ex.l_orderkey = l.l_orderkey AND ex.l_linenumber = l.l_linenumber))""")


def _two_keys(source: str) -> str:
    """Settled in rounds: rows come in the order of all columns; a row that is
    the first undecided one of both keys goes in, rows that share a key with it
    are out."""
    return f"""
        WITH RECURSIVE n AS (
          SELECT row_number() OVER (ORDER BY {_ORDER}, l_orderkey, l_linenumber) AS seq, * FROM {source}),
        r AS (
          SELECT seq, l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS state FROM n
          UNION ALL
          SELECT seq, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CASE WHEN goes THEN 1 WHEN max(goes) OVER (PARTITION BY l_orderkey, l_linenumber)
                   OR max(goes) OVER (PARTITION BY l_partkey, l_suppkey) THEN -1 ELSE 0 END
          FROM (SELECT *, seq = min(seq) OVER (PARTITION BY l_orderkey, l_linenumber)
                      AND seq = min(seq) OVER (PARTITION BY l_partkey, l_suppkey) AS goes
                FROM r WHERE state = 0))
        SELECT n.* EXCLUDE (seq) FROM n JOIN r USING (seq) WHERE r.state = 1"""


ORACLES = {
    "insert_ignore_two_keys": _two_keys("lineitem"),
    "insert_ignore_two_keys_existing": f"""WITH ex AS ({_two_keys(f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}')")}),
        left_over AS (
          SELECT * FROM lineitem l
          WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.l_orderkey = l.l_orderkey AND ex.l_linenumber = l.l_linenumber)
            AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.l_partkey = l.l_partkey AND ex.l_suppkey = l.l_suppkey))
        SELECT * FROM ({_two_keys("left_over")})""",
    "load_with_rules": """WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0)
        SELECT 'offered' AS metric, 2 * count(*) AS value FROM orders
        UNION ALL SELECT 'inserted', count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 'total', count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 'violations of not null o_orderpriority', count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'violations of foreign key o_custkey', count(DISTINCT o_orderkey) FROM orders
          WHERE o_custkey NOT IN (SELECT c_custkey FROM c)""",
    "table_violations": """
        SELECT 'lineitem' AS "table", 'not_null' AS "constraint", 'l_shipdate' AS columns, count(*) AS violations
        FROM lineitem WHERE l_shipdate IS NULL
        UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey,l_linenumber', coalesce(sum(n - 1), 0)::BIGINT
          FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        UNION ALL SELECT 'lineitem', 'foreign_key', 'l_suppkey', count(*) FROM lineitem
          WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "table_lifecycle": """
        SELECT 'loaded' AS step, count(*) AS n FROM orders
        UNION ALL SELECT 'truncated', 0
        UNION ALL SELECT 'reloaded', count(*) FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'recreated', count(*) FROM customer""",
    "insert_ignore": _FIRST.format(src="lineitem"),
    "insert_ignore_existing": f"WITH ex AS ({_EXISTING}) SELECT * FROM ex UNION ALL ({_NEW})",
    "seed_report": f"""WITH ex AS ({_EXISTING}), nw AS ({_NEW})
        SELECT 'offered' AS metric, CAST(count(*) AS BIGINT) AS value FROM lineitem
        UNION ALL SELECT 'inserted', CAST(count(*) AS BIGINT) FROM nw
        UNION ALL SELECT 'total', CAST((SELECT count(*) FROM ex) + count(*) AS BIGINT) FROM nw""",
    "assign_ids": f"""SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS BIGINT) AS id, *
        FROM ({_FIRST.format(src='lineitem')})""",
    "append_all": "SELECT * FROM lineitem",
    "create_if_absent": "SELECT * FROM orders",
    "table_counts": f"""SELECT 'orders' AS "table", CAST(count(DISTINCT o_orderkey) AS BIGINT) AS rows FROM orders
        UNION ALL SELECT 'customer', CAST(count(DISTINCT c_custkey) AS BIGINT) FROM customer
        UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT)
          FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
    "truncate_seconds": "SELECT event_id, date_trunc('second', ts) AS ts FROM events",
    "check_constraints": """
        SELECT 'lineitem' AS "table", 'not_null' AS "constraint", c AS columns, CAST(v AS BIGINT) AS violations
        FROM (SELECT count_if(l_orderkey IS NULL) AS l_orderkey, count_if(l_partkey IS NULL) AS l_partkey,
                     count_if(l_suppkey IS NULL) AS l_suppkey, count_if(l_linenumber IS NULL) AS l_linenumber
              FROM lineitem) UNPIVOT (v FOR c IN (l_orderkey, l_partkey, l_suppkey, l_linenumber))
        UNION ALL SELECT 'lineitem', 'unique', 'l_orderkey,l_linenumber',
          CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
                GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem', 'foreign_key', 'l_orderkey', CAST(count(*) AS BIGINT) FROM lineitem
          WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
        UNION ALL SELECT 'lineitem', 'foreign_key', 'l_partkey', CAST(count(*) AS BIGINT) FROM lineitem
          WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
        UNION ALL SELECT 'lineitem', 'foreign_key', 'l_suppkey', CAST(count(*) AS BIGINT) FROM lineitem
          WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)
        UNION ALL
        SELECT 'orders', 'not_null', c, CAST(v AS BIGINT)
        FROM (SELECT count_if(o_orderkey IS NULL) AS o_orderkey, count_if(o_custkey IS NULL) AS o_custkey
              FROM orders) UNPIVOT (v FOR c IN (o_orderkey, o_custkey))
        UNION ALL SELECT 'orders', 'unique', 'o_orderkey', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
          FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'orders', 'foreign_key', 'o_custkey', CAST(count(*) AS BIGINT) FROM orders
          WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
    """,
}
