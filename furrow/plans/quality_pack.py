"""Registered data-quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import profile as P
from furrow.operators.quality import Expect, failing_key_rows, run_suite, schema_expectations
from furrow.sources.schemas import get_schema
from furrow.sources.tables import load


def dq_suite(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer")
    return run_suite(o, [
        Expect("not_null", "o_orderkey"),
        Expect("unique", "o_orderkey"),
        Expect("in_set", "o_orderstatus", ("F", "O", "P")),
        Expect("between", "o_totalprice", (0, 400000)),
        Expect("matches_regex", "o_orderpriority", ("^[1-5]-",)),
        Expect("foreign_key", "o_custkey", ref=c, ref_column="c_custkey"),
    ])


def _schema_suite() -> list[Expect]:
    return schema_expectations(get_schema("sales_orders")) + [
        Expect("between", "subtotal", (10, 1000)),
        Expect("matches_regex", "order_number", ("^ORD-[0-9A-F]{12,}$",)),
        Expect("row_count_between", "", (1, 10 ** 12)),
    ]


def dq_schema_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The schema's declared constraints (and the generator's time rule) as an
    expectation suite over the generated sales orders (one per order)."""
    from furrow.plans.generate_pack import generated
    return run_suite(generated(spark, sf, "sales_orders"), _schema_suite())


def dq_failing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return failing_key_rows(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def profile_wide_integers(spark: SparkSession, sf: str) -> DataFrame:
    """Ids above 2 ** 53, which a double cannot tell apart."""
    o = load(spark, sf, "orders").select((F.col("o_orderkey") + (1 << 53)).alias("wide_key"),
                                         F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") + (1 << 60)).alias("wide_cust"))
    return P.profile_integers(o, "orders")


def profile_own_types(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers and decimals that a double cannot tell apart, profiled in
    their own types (the exact columns of the profile)."""
    key = F.col("o_orderkey")
    o = load(spark, sf, "orders").select((key + (1 << 53)).alias("wide_key"),
                                         F.when(key % 5 > 0, F.col("o_custkey") + (1 << 60)).alias("wide_cust"),
                                         (key + F.expr("900719925474099200.00BD")).cast("decimal(25,2)").alias("wide_price"))
    return P.profile_numeric(o, "orders").select("table", "column", "count", "nulls", "distinct", "min_text", "max_text")


def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    part = P.profile_numeric(load(spark, sf, "part"), "part", ["p_partkey", "p_size", "p_retailprice"])
    ev = P.profile_numeric(load(spark, sf, "events"), "events", ["event_id", "user_id", "value"])
    return part.unionByName(ev)


def profile_topk(spark: SparkSession, sf: str) -> DataFrame:
    o = P.profile_topk(load(spark, sf, "orders"), "orders", ["o_orderstatus", "o_orderpriority"])
    p = P.profile_topk(load(spark, sf, "part"), "part", ["p_name", "p_brand", "p_type"])
    return o.unionByName(p)


def profile_corr(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_corr(load(spark, sf, "lineitem"),
                          ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


QUERIES = {
    "dq_suite": dq_suite,
    "dq_failing_rows": dq_failing_rows,
    "dq_schema_rules": dq_schema_rules,
    "profile_numeric": profile_numeric,
    "profile_wide_integers": profile_wide_integers,
    "profile_own_types": profile_own_types,
    "profile_topk": profile_topk,
    "profile_corr": profile_corr,
}


def _num_profile_sql(table: str, col: str, whole: bool = False) -> str:
    v = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{table}' AS "table", '{col}' AS "column", count({v}) AS count,
        CAST(count_if({v} IS NULL) AS BIGINT) AS nulls, CAST(count(DISTINCT {col}) AS BIGINT) AS "distinct",
        round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean,
        round(stddev_samp({v}), 6) AS stddev, round(quantile_cont({v}, 0.25), 6) AS p25,
        round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.95), 6) AS p95,
        {f"CAST(min({col}) AS VARCHAR)" if whole else "NULL::VARCHAR"} AS min_text,
        {f"CAST(max({col}) AS VARCHAR)" if whole else "NULL::VARCHAR"} AS max_text
        FROM {table}"""


def _topk_sql(table: str, col: str) -> str:
    return f"""SELECT '{table}' AS "table", '{col}' AS "column", value, count, rank FROM (
        SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS rank
        FROM (SELECT {col} AS value, count(*) AS count FROM {table} WHERE {col} IS NOT NULL GROUP BY 1))
        WHERE rank <= 5"""


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _expectation_sql(e: Expect, table: str) -> str:
    """DuckDB text of one rule."""
    c = e.column
    if e.rule == "not_null":
        ev, bad = "count(*)", f"count_if({c} IS NULL)"
    elif e.rule == "in_set":
        lits = ", ".join("'" + str(v).replace("'", "''") + "'" for v in e.args)
        ev, bad = f"count({c})", f"count_if({c} IS NOT NULL AND {c} NOT IN ({lits}))"
    elif e.rule == "between":
        ev, bad = f"count({c})", f"count_if({c} IS NOT NULL AND {c} NOT BETWEEN {e.args[0]} AND {e.args[1]})"
    elif e.rule == "matches_regex":
        ev, bad = f"count({c})", f"count_if({c} IS NOT NULL AND NOT regexp_matches({c}, '{e.args[0]}'))"
    elif e.rule == "max_length":
        ev, bad = f"count({c})", f"count_if({c} IS NOT NULL AND length({c}) > {e.args[0]})"
    elif e.rule == "column_a_le_b":
        a, b = c
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        ev, bad = f"count_if({both})", f"count_if({both} AND {a} > {b})"
    elif e.rule == "row_count_between":
        ev = "count(*)"
        bad = f"CASE WHEN count(*) < {e.args[0]} OR count(*) > {e.args[1]} THEN count(*) ELSE 0 END"
    elif e.rule == "unique":
        return (f"SELECT '{e.name}' AS rule, coalesce(sum(n), 0) AS evaluated, "
                f"coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS unexpected FROM "
                f"(SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})")
    else:
        raise ValueError(e.rule)
    return f"SELECT '{e.name}' AS rule, {ev} AS evaluated, {bad} AS unexpected FROM {table}"


def _suite_sql(expectations: list[Expect], table: str, mostly: float = 1.0) -> str:
    """DuckDB text of ``run_suite`` over ``table`` (row and unique rules)."""
    body = "\n UNION ALL ".join(_expectation_sql(e, table) for e in expectations)
    return f"""SELECT rule, CAST(evaluated AS BIGINT) AS evaluated, CAST(unexpected AS BIGINT) AS unexpected,
        CASE WHEN evaluated > 0 THEN round(unexpected * 100.0 / evaluated, 6) ELSE 0.0 END AS unexpected_pct,
        CASE WHEN evaluated > 0 THEN evaluated - unexpected >= {mostly} * evaluated ELSE unexpected = 0 END
          AS success
        FROM ({body}) r"""


def _schema_rules_sql() -> str:
    from furrow.plans.generate_pack import _oracle_gen
    return f"WITH so AS ({_oracle_gen('sales_orders')}) " + _suite_sql(_schema_suite(), "so")


_WIDE = """SELECT (o_orderkey + 9007199254740992)::BIGINT AS wide_key,
       (CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + 1152921504606846976 END)::BIGINT AS wide_cust,
       (o_orderkey::DECIMAL(25,2) + 900719925474099200.00::DECIMAL(25,2))::DECIMAL(25,2) AS wide_price FROM orders"""

ORACLES = {
    "dq_schema_rules": _schema_rules_sql(),
    "dq_suite": """
        WITH r AS (
          SELECT 'not_null(o_orderkey)' AS rule, count(*) AS evaluated, count_if(o_orderkey IS NULL) AS unexpected FROM orders
          UNION ALL SELECT 'in_set(o_orderstatus)', count(o_orderstatus),
                 count_if(o_orderstatus NOT IN ('F', 'O', 'P')) FROM orders
          UNION ALL SELECT 'between(o_totalprice)', count(o_totalprice),
                 count_if(o_totalprice NOT BETWEEN 0 AND 400000) FROM orders
          UNION ALL SELECT 'matches_regex(o_orderpriority)', count(o_orderpriority),
                 count_if(NOT regexp_matches(o_orderpriority, '^[1-5]-')) FROM orders
          UNION ALL SELECT 'unique(o_orderkey)', coalesce(sum(n), 0), coalesce(sum(CASE WHEN n > 1 THEN n END), 0)
                 FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey)
          UNION ALL SELECT 'foreign_key(o_custkey)', count(o_custkey),
                 count_if(o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL))
                 FROM orders)
        SELECT rule, CAST(evaluated AS BIGINT) AS evaluated, CAST(unexpected AS BIGINT) AS unexpected,
               CASE WHEN evaluated > 0 THEN round(unexpected * 100.0 / evaluated, 6) ELSE 0.0 END AS unexpected_pct,
               CASE WHEN evaluated > 0 THEN evaluated - unexpected >= evaluated ELSE unexpected = 0 END AS success
        FROM r""",
    "dq_failing_rows": """
        SELECT l.*, d.copies FROM lineitem l JOIN (
          SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
          GROUP BY 1, 2 HAVING count(*) > 1) d USING (l_orderkey, l_linenumber)""",
    "profile_numeric": " UNION ALL ".join(
        [_num_profile_sql("part", "p_partkey", True), _num_profile_sql("part", "p_size", True), _num_profile_sql("part", "p_retailprice"),
         _num_profile_sql("events", "event_id", True), _num_profile_sql("events", "user_id", True), _num_profile_sql("events", "value")]),
    "profile_own_types": f"""WITH w AS ({_WIDE}) """ + " UNION ALL ".join(
        f"""SELECT 'orders' AS "table", '{c}' AS "column", count({c}) AS count, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls,
        count(DISTINCT {c}) AS "distinct", CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text FROM w"""
        for c in ["wide_key", "wide_cust", "wide_price"]),
    "profile_wide_integers": """
        WITH w AS (SELECT o_orderkey + 9007199254740992 AS wide_key,
                          CASE WHEN o_orderkey % 5 > 0 THEN o_custkey + 1152921504606846976 END AS wide_cust FROM orders)
        SELECT 'orders' AS "table", 'wide_key' AS "column", count(wide_key) AS "count",
               CAST(count_if(wide_key IS NULL) AS BIGINT) AS nulls, count(DISTINCT wide_key) AS "distinct",
               min(wide_key)::BIGINT AS "min", max(wide_key)::BIGINT AS "max" FROM w
        UNION ALL SELECT 'orders', 'wide_cust', count(wide_cust), CAST(count_if(wide_cust IS NULL) AS BIGINT),
               count(DISTINCT wide_cust), min(wide_cust)::BIGINT, max(wide_cust)::BIGINT FROM w""",
    "profile_topk": " UNION ALL ".join(
        [_topk_sql("orders", c) for c in ["o_orderstatus", "o_orderpriority"]]
        + [_topk_sql("part", c) for c in ["p_name", "p_brand", "p_type"]]),
    "profile_corr": " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]),
}
