"""Ad-hoc SQL over registered tables, plus the operators Spark SQL does
not scale by itself (skew-safe ordered windows, salted top-k per group,
bucketed range join).

The SQL keys are plain ``spark.sql`` over temp views of the provided tables:
Catalyst does the planning (pushdown, pruning, partial aggregation, AQE join
choice); these keys are parity checks of that path against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.ordered_window import ordered_window
from furrow.functions.topk import top_k, top_k_per_group
from furrow.operators.joins import range_join
from furrow.sources.tables import load, register_views

# key -> (Spark SQL, DuckDB SQL); None means "same text"
SQL: dict[str, tuple[str, str | None]] = {
    "sql_filter_project": ("""
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
        WHERE o_orderstatus = 'F' AND o_totalprice > 200000""", None),
    "join_inner": ("""
        SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""", None),
    "join_left": ("""
        SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS orders,
               round(coalesce(sum(o.o_totalprice), 0), 2) AS spend
        FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
        GROUP BY c.c_custkey, c.c_name""", None),
    "join_semi": ("""
        SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (
          SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
            AND o.o_totalprice > 400000 AND o.o_orderstatus = 'F')""", None),
    "join_anti": ("""
        SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (
          SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
            AND o.o_totalprice > 400000 AND o.o_orderstatus = 'F')""", None),
    "agg_group": ("""
        SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total,
               round(avg(o_totalprice), 4) AS avg_price, min(o_orderdate) AS first_date,
               max(o_orderdate) AS last_date
        FROM orders GROUP BY o_orderstatus, o_orderpriority""", None),
    "agg_distinct": ("""
        SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers,
               count(DISTINCT o_orderpriority) AS priorities
        FROM orders GROUP BY o_orderstatus""", None),
    "agg_rollup": ("""
        SELECT o_orderstatus, o_orderpriority,
               CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid,
               count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""", None),
    "agg_cube": ("""
        SELECT o_orderstatus, o_orderpriority,
               CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid,
               count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""", None),
    "agg_grouping_sets": ("""
        SELECT o_orderstatus, o_orderpriority,
               CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid,
               count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""", None),
    "set_union": ("""
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
        UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""", None),
    "set_intersect": ("""
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
        INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""", None),
    "set_except": ("""
        SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
        EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""", None),
    "fn_string": ("""
        SELECT p_partkey, upper(p_name) AS name_upper, length(p_name) AS name_len,
               substr(p_name, 1, 4) AS name_head, concat(p_brand, '-', p_type) AS brand_type,
               replace(p_brand, 'Brand#', 'B') AS brand_short,
               lpad(cast(p_size AS STRING), 3, '0') AS size_padded,
               regexp_replace(p_name, '[aeiou]', '') AS consonants,
               split_part(p_name, ' ', 2) AS second_word
        FROM part""", """
        SELECT p_partkey, upper(p_name) AS name_upper, CAST(length(p_name) AS INTEGER) AS name_len,
               substr(p_name, 1, 4) AS name_head, concat(p_brand, '-', p_type) AS brand_type,
               replace(p_brand, 'Brand#', 'B') AS brand_short,
               lpad(CAST(p_size AS VARCHAR), 3, '0') AS size_padded,
               regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants,
               split_part(p_name, ' ', 2) AS second_word
        FROM part"""),
    "fn_date": ("""
        SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d,
               dayofweek(o_orderdate) AS dow, to_date(o_orderdate) AS order_day,
               date_add(to_date(o_orderdate), 30) AS due_day,
               datediff(to_date('2002-01-01'), to_date(o_orderdate)) AS age_days,
               last_day(to_date(o_orderdate)) AS month_end, date_format(o_orderdate, 'yyyy-MM') AS ym,
               quarter(o_orderdate) AS q
        FROM orders""", """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
               CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
               CAST(o_orderdate AS DATE) AS order_day,
               CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_day,
               CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age_days,
               last_day(CAST(o_orderdate AS DATE)) AS month_end, strftime(o_orderdate, '%Y-%m') AS ym,
               CAST(quarter(o_orderdate) AS INTEGER) AS q
        FROM orders"""),
    "fn_math": ("""
        SELECT l_orderkey, l_linenumber,
               CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
                     * (1 + CAST(l_tax AS DECIMAL(15,2))), 2) AS DECIMAL(18,2)) AS charge,
               CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil,
               CAST(floor(l_extendedprice) AS BIGINT) AS price_floor,
               round(sqrt(l_quantity), 6) AS qty_sqrt, round(ln(l_extendedprice), 6) AS price_ln,
               round(power(l_discount, 2), 6) AS disc_sq, abs(l_quantity - 25) AS qty_dev,
               l_orderkey % 7 AS bucket7, sign(l_tax - 0.04) AS tax_sign
        FROM lineitem""", """
        SELECT l_orderkey, l_linenumber,
               CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
                     * (1 + CAST(l_tax AS DECIMAL(15,2))), 2) AS DECIMAL(18,2)) AS charge,
               CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil,
               CAST(floor(l_extendedprice) AS BIGINT) AS price_floor,
               round(sqrt(l_quantity), 6) AS qty_sqrt, round(ln(l_extendedprice), 6) AS price_ln,
               round(power(l_discount, 2), 6) AS disc_sq, abs(l_quantity - 25) AS qty_dev,
               l_orderkey % 7 AS bucket7, CAST(sign(l_tax - 0.04) AS DOUBLE) AS tax_sign
        FROM lineitem"""),
    "fn_json": ("""
        SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k,
               get_json_object(props, '$.missing') IS NULL AS no_missing,
               to_json(named_struct('id', event_id, 'type', event_type)) AS as_json
        FROM events""", """
        SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
               json_extract(props, '$.missing') IS NULL AS no_missing,
               CAST(to_json({'id': event_id, 'type': event_type}) AS VARCHAR) AS as_json
        FROM events"""),
    "fn_array": ("""
        SELECT p_partkey, size(split(p_name, ' ')) AS words, element_at(split(p_name, ' '), 1) AS first_word,
               array_contains(split(p_name, ' '), 'widget') AS is_widget,
               array_join(array_sort(split(p_name, ' ')), ',') AS sorted_words,
               array_join(transform(split(p_name, ' '), w -> upper(w)), ' ') AS upper_words
        FROM part""", """
        SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words, string_split(p_name, ' ')[1] AS first_word,
               list_contains(string_split(p_name, ' '), 'widget') AS is_widget,
               array_to_string(list_sort(string_split(p_name, ' ')), ',') AS sorted_words,
               array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w)), ' ') AS upper_words
        FROM part"""),
}


def _sql_query(key: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        register_views(spark, sf)
        return spark.sql(SQL[key][0])
    q.__name__ = key
    return q


# ---------------------------------------------------------------- operators


def _orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def win_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_window(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"], rank="rank")


def win_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    r = ordered_window(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       running_sums={"running_total": "o_totalprice"})
    return r.withColumn("running_total", F.round("running_total", 2))


def win_running_sum_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A measure that is null for most rows, and for the first ones of many keys."""
    o = _orders(spark, sf).withColumn("paid", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")))
    return ordered_window(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], running_sums={"paid_total": "paid"}) \
        .select("o_orderkey", "o_custkey", "paid", "paid_total")


def win_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_window(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                          lags={"prev_price": "o_totalprice", "prev_date": "o_orderdate"},
                          leads={"next_price": "o_totalprice"})


def topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(_orders(spark, sf), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return top_k_per_group(_orders(spark, sf), ["o_custkey"],
                           [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def join_range(spark: SparkSession, sf: str) -> DataFrame:
    """Events to the hourly range table built from the spine of their hours."""
    ev = load(spark, sf, "events").select("event_id", "ts", "value")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    spine = ev.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("range_start"))
    ranges = spine.withColumn("range_end", F.col("range_start") + F.expr("INTERVAL 1 HOUR"))
    j = range_join(ev, ranges, "ts", "range_start", "range_end", 3600)
    return j.groupBy("range_start", "range_end").agg(F.count(F.lit(1)).alias("events"),
                                                     F.round(F.sum("value"), 2).alias("value_sum"))


QUERIES = {k: _sql_query(k) for k in SQL}
QUERIES.update({
    "win_rank": win_rank,
    "win_running_sum": win_running_sum,
    "win_running_sum_nulls": win_running_sum_nulls,
    "win_lag_lead": win_lag_lead,
    "topk": topk,
    "top_per_group": top_per_group,
    "join_range": join_range,
})

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
ORACLES = {k: (duck or spark_sql) for k, (spark_sql, duck) in SQL.items()}
ORACLES.update({
    "win_rank": f"""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
        CAST(rank() OVER ({_W}) AS BIGINT) AS rank FROM orders""",
    "win_running_sum_nulls": f"""WITH o AS (
          SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS paid FROM orders)
        SELECT o_orderkey, o_custkey, paid,
          CAST(sum(paid) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paid_total FROM o""",
    "win_running_sum": f"""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
        round(sum(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders""",
    "win_lag_lead": f"""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
        lag(o_totalprice) OVER ({_W}) AS prev_price, lag(o_orderdate) OVER ({_W}) AS prev_date,
        lead(o_totalprice) OVER ({_W}) AS next_price FROM orders""",
    "topk": """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "top_per_group": """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
                       AS INTEGER) AS rank
        FROM orders) WHERE rank <= 3""",
    "join_range": """WITH r AS (
          SELECT h AS range_start, h + INTERVAL 1 HOUR AS range_end
          FROM generate_series((SELECT min(date_trunc('hour', ts)) FROM events),
                               (SELECT max(date_trunc('hour', ts)) FROM events), INTERVAL 1 HOUR) g(h))
        SELECT r.range_start, r.range_end, count(*) AS events, round(sum(e.value), 2) AS value_sum
        FROM events e JOIN r ON e.ts >= r.range_start AND e.ts < r.range_end
        GROUP BY r.range_start, r.range_end""",
})
