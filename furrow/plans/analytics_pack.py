"""Registered time-series, semantic-layer and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import incremental as I
from furrow.operators import metrics as M
from furrow.operators import timeseries as TS
from furrow.operators.sink import Store
from furrow.session import scratch_path
from furrow.sources.tables import load

# ---------------------------------------------------------------- R5


def _daily(spark, sf) -> DataFrame:
    ev = load(spark, sf, "events")
    agg = TS.aggregate_series(ev, "ts", "day", ["event_type"],
                              {"events": F.count(F.lit(1)), "value_sum": F.sum("value")})
    return TS.fill_gaps(agg, "day", ["event_type"], {"events": 0, "value_sum": 0.0})


def ts_daily_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(F.col("bucket").alias("day"), "event_type", "events",
                                    F.round("value_sum", 2).alias("value_sum"))


def ts_moving_avg(spark: SparkSession, sf: str) -> DataFrame:
    d = TS.moving_average(_daily(spark, sf), ["event_type"], "events", 7)
    return d.select(F.col("bucket").alias("day"), "event_type", "events",
                    F.round("moving_avg", 6).alias("moving_avg"))


def ts_period_over_period(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    wk = TS.aggregate_series(ev, "ts", "week", ["event_type"], {"value_sum": F.sum("value")})
    p = TS.period_over_period(wk, ["event_type"], "value_sum", "week")
    return p.select("event_type", F.col("bucket").alias("week"),
                    F.round("value_sum", 2).alias("value_sum"), F.round("previous", 2).alias("previous"),
                    F.round("change", 2).alias("change"))


def ts_filled_null_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts where purchases carry no series value: a series of its own."""
    ev = load(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") != "purchase", F.col("event_type")))
    daily = TS.aggregate_series(ev, "ts", "day", ["kind"], {"events": F.count(F.lit(1))})
    return TS.fill_gaps(daily, "day", ["kind"], {"events": 0}).select("kind", F.col("bucket").alias("day"), "events")


def ts_previous_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Day over day for users: most have days without events."""
    ev = load(spark, sf, "events")
    daily = TS.aggregate_series(ev, "ts", "day", ["user_id"], {"events": F.count(F.lit(1))})
    return TS.period_over_period(daily, ["user_id"], "events", "day").select(
        "user_id", F.col("bucket").alias("day"), "events", "previous", "change")


def ts_hours_over_clock_change(spark: SparkSession, sf: str) -> DataFrame:
    """Hour buckets of wall-clock times on a day with a clock change (the
    events' days moved to 10 March 2024)."""
    ev = load(spark, sf, "events")
    moved = F.to_timestamp_ntz(F.concat(F.lit("2024-03-10 "), F.date_format(F.col("ts"), "HH:mm:ss")))
    return TS.aggregate_series(ev.withColumn("wall", moved), "wall", "hour", [], {"events": F.count(F.lit(1))}) \
        .select(F.col("bucket").alias("hour"), "events")


def date_histogram(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").where(F.col("event_type") == "click")
    return TS.aggregate_series(ev, "ts", "hour", [], {"events": F.count(F.lit(1))}) \
        .select(F.col("bucket").alias("hour"), "events")


# ---------------------------------------------------------------- R4


def _money(c: str):
    """Money is summed as an exact decimal so the total does not depend on the
    order in which partial sums meet."""
    return F.col(c).cast("decimal(15,2)")


def sales_cube(spark: SparkSession, sf: str) -> M.Cube:
    """Star: lineitem -> orders -> customer -> nation -> region.

    Lines are first pre-aggregated per order (partial aggregation, ~4x fewer
    rows to shuffle into the join); the order side is joined to its small
    dimensions first, so the big join happens once, on o_orderkey.
    """
    li = (load(spark, sf, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(_money("l_extendedprice") * (1 - _money("l_discount"))).alias("rev"),
               F.count(F.lit(1)).alias("n_lines")))
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    dims = (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    fact = li.join(dims, li.l_orderkey == dims.o_orderkey)
    return M.Cube(fact, {
        "revenue": M.Measure("revenue", "sum", "rev"),
        "lines": M.Measure("lines", "sum", "n_lines"),
        "customers": M.Measure("customers", "count_distinct", "o_custkey"),
        "revenue_per_line": M.Measure("revenue_per_line", "ratio", ("rev", "n_lines")),
    }, {"n_name": "n_name", "r_name": "r_name"}, time_dimension="o_orderdate")


def cube_revenue_by_nation_month(spark: SparkSession, sf: str) -> DataFrame:
    q = sales_cube(spark, sf).query(["revenue", "lines", "customers"], ["n_name"], "month")
    return q.select("n_name", "month", F.round("revenue", 2).cast("decimal(18,2)").alias("revenue"),
                    F.col("lines").cast("bigint").alias("lines"), F.col("customers").cast("bigint").alias("customers"))


def cube_preagg_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Nation x month pre-aggregate is stored once; the nation x year query is
    answered from the stored table (additive measures only)."""
    store = Store(spark, scratch_path(spark, "preagg"), "duckdb")
    pre = (sales_cube(spark, sf).preaggregate(["revenue", "lines"], ["n_name"], "month")
           .persist(store, "sales_by_nation_month"))
    q = pre.answer(["revenue", "lines"], ["n_name"], "year")
    return q.select("n_name", F.col("year").cast("int").alias("year"), F.round("revenue", 2).cast("decimal(18,2)").alias("revenue"),
                    F.col("lines").cast("bigint").alias("lines"))


def cube_ratio_by_region_year(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio measure (revenue per line) by region and year, answered from
    the persisted region x nation x month pre-aggregate (ratio re-aggregated
    from its summed parts)."""
    store = Store(spark, scratch_path(spark, "preagg"), "duckdb")
    pre = (sales_cube(spark, sf)
           .preaggregate(["revenue_per_line", "lines"], ["r_name", "n_name"], "month")
           .persist(store, "sales_by_region_nation_month"))
    q = pre.answer(["revenue_per_line", "lines"], ["r_name"], "year")
    return q.select("r_name", F.col("year").cast("int").alias("year"),
                    F.round("revenue_per_line", 4).alias("revenue_per_line"),
                    F.col("lines").cast("bigint").alias("lines"))


def cube_rollup(spark: SparkSession, sf: str) -> DataFrame:
    q = sales_cube(spark, sf).rollup(["revenue", "lines", "customers"], ["r_name", "n_name"])
    return q.select("r_name", "n_name", "gid", F.round("revenue", 2).cast("decimal(18,2)").alias("revenue"),
                    F.col("lines").cast("bigint").alias("lines"), F.col("customers").cast("bigint").alias("customers"))


# ---------------------------------------------------------------- R7


def _base_and_changes(spark: SparkSession, sf: str):
    o = load(spark, sf, "orders")
    top = o.agg(F.max("o_orderkey")).first()[0] + 1
    half, quarter = top // 2, top // 4
    base = o.where(F.col("o_orderkey") < half).withColumn("version", F.lit(1))
    changes = (o.where(F.col("o_orderkey") >= quarter).withColumn("o_orderstatus", F.lit("X"))
               .withColumn("version", F.lit(2)))
    return base, changes


def cube_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """R4 with caller filters on the star's columns."""
    return sales_cube(spark, sf).query(["revenue", "lines"], ["r_name"], "month",
                                       ["r_name IN ('ASIA', 'EUROPE')", "o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"]) \
        .select("r_name", "month", F.round("revenue", 2).cast("decimal(18,2)").alias("revenue"), F.col("lines").cast("bigint").alias("lines"))


def incremental_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Base: orders below half the key range (version 1). Change set: the upper
    three quarters with o_orderstatus 'X' (version 2). Latest version wins."""
    base, changes = _base_and_changes(spark, sf)
    return I.upsert(base, changes, "o_orderkey", "version")


def incremental_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Full refresh of a model table: the base is published first, then the
    rebuilt model (base upserted with the changes) replaces it atomically."""
    base, changes = _base_and_changes(spark, sf)
    store = Store(spark, scratch_path(spark, "models"), "duckdb")
    I.full_refresh(store, "orders_model", base)
    I.full_refresh(store, "orders_model", I.upsert(store.read("orders_model"), changes,
                                                   "o_orderkey", "version"))
    return store.read("orders_model")


QUERIES = {
    "ts_daily_filled": ts_daily_filled,
    "ts_moving_avg": ts_moving_avg,
    "ts_period_over_period": ts_period_over_period,
    "ts_filled_null_series": ts_filled_null_series,
    "ts_previous_with_gaps": ts_previous_with_gaps,
    "ts_hours_over_clock_change": ts_hours_over_clock_change,
    "date_histogram": date_histogram,
    "cube_revenue_by_nation_month": cube_revenue_by_nation_month,
    "cube_preagg_reuse": cube_preagg_reuse,
    "cube_rollup": cube_rollup,
    "cube_filtered": cube_filtered,
    "cube_ratio_by_region_year": cube_ratio_by_region_year,
    "incremental_upsert": incremental_upsert,
    "incremental_full_refresh": incremental_full_refresh,
}

_DAILY = """daily AS (
  SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, sum(value) AS value_sum
  FROM events GROUP BY 1, 2),
spine AS (
  SELECT CAST(d AS DATE) AS day, t.event_type
  FROM (SELECT DISTINCT event_type FROM events) t,
       generate_series((SELECT min(day) FROM daily)::TIMESTAMP, (SELECT max(day) FROM daily)::TIMESTAMP,
                       INTERVAL 1 DAY) g(d)),
filled AS (
  SELECT s.day, s.event_type, coalesce(d.events, 0) AS events, coalesce(d.value_sum, 0.0) AS value_sum
  FROM spine s LEFT JOIN daily d USING (day, event_type))"""

_STAR = """star AS (
  SELECT CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2))) AS rev, o.o_custkey, o.o_orderdate, n.n_name, r.r_name
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

ORACLES = {
    "ts_daily_filled": f"WITH {_DAILY} SELECT day, event_type, events, round(value_sum, 2) AS value_sum FROM filled",
    "ts_moving_avg": f"""WITH {_DAILY} SELECT day, event_type, events,
        round(avg(events) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
          AS moving_avg FROM filled""",
    "ts_period_over_period": """WITH w AS (
          SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, sum(value) AS value_sum
          FROM events GROUP BY 1, 2)
        SELECT c.event_type, c.week, round(c.value_sum, 2) AS value_sum,
               round(p.value_sum, 2) AS previous, round(c.value_sum - p.value_sum, 2) AS change
        FROM w c LEFT JOIN w p ON p.week = c.week - INTERVAL 7 DAY
          AND p.event_type IS NOT DISTINCT FROM c.event_type""",
    "ts_filled_null_series": """WITH d AS (
          SELECT CASE WHEN event_type <> 'purchase' THEN event_type END AS kind, CAST(ts AS DATE) AS day, count(*) AS n
          FROM events GROUP BY 1, 2),
        spine AS (SELECT k.kind, CAST(s.day AS DATE) AS day FROM (SELECT DISTINCT kind FROM d) k,
          (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS day) s)
        SELECT s.kind, s.day, coalesce(d.n, 0)::BIGINT AS events
        FROM spine s LEFT JOIN d ON d.day = s.day AND d.kind IS NOT DISTINCT FROM s.kind""",
    "ts_previous_with_gaps": """WITH d AS (
          SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1, 2)
        SELECT c.user_id, c.day, c.events, p.events AS previous, c.events - p.events AS change
        FROM d c LEFT JOIN d p ON p.user_id IS NOT DISTINCT FROM c.user_id AND p.day = c.day - INTERVAL 1 DAY""",
    "ts_hours_over_clock_change": """SELECT TIMESTAMP '2024-03-10 00:00:00' + to_hours(hour(ts)) AS hour, count(*) AS events
        FROM events GROUP BY 1""",
    "date_histogram": """SELECT date_trunc('hour', ts) AS hour, count(*) AS events
        FROM events WHERE event_type = 'click' GROUP BY 1""",
    "cube_revenue_by_nation_month": f"""WITH {_STAR}
        SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue,
               CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
        FROM star GROUP BY 1, 2""",
    "cube_preagg_reuse": f"""WITH {_STAR}
        SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue,
               CAST(count(*) AS BIGINT) AS lines
        FROM star GROUP BY 1, 2""",
    "cube_ratio_by_region_year": f"""WITH {_STAR}
        SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year,
               round(CAST(sum(rev) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS revenue_per_line,
               CAST(count(*) AS BIGINT) AS lines
        FROM star GROUP BY 1, 2""",
    "cube_filtered": f"""WITH {_STAR}
        SELECT r_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue, CAST(count(*) AS BIGINT) AS lines
        FROM star WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
        GROUP BY 1, 2""",
    "cube_rollup": f"""WITH {_STAR}
        SELECT r_name, n_name, CAST(grouping_id(r_name, n_name) AS BIGINT) AS gid, CAST(round(sum(rev), 2) AS DECIMAL(18,2)) AS revenue,
               CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
        FROM star GROUP BY ROLLUP (r_name, n_name)""",
    "incremental_upsert": """WITH m AS (SELECT max(o_orderkey) + 1 AS top FROM orders),
        base AS (SELECT *, 1 AS v FROM orders WHERE o_orderkey < (SELECT top // 2 FROM m)),
        ch AS (SELECT * REPLACE ('X' AS o_orderstatus), 2 AS v FROM orders
               WHERE o_orderkey >= (SELECT top // 4 FROM m)),
        u AS (SELECT * FROM base UNION ALL SELECT * FROM ch)
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, v AS version
        FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1""",
}

ORACLES["incremental_full_refresh"] = ORACLES["incremental_upsert"]
