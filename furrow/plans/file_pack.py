"""Registered file queries (R9, R7, K10, S2, S4): CSV and JSON with and without
bad records, partitions merged in place, bulk files, types and flavours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.incremental import merge_partitions, write_partitions
from furrow.operators.sink import Store
from furrow.plans.generate_pack import generated
from furrow.session import scratch_path
from furrow.sources.bulk import read_bulk, write_bulk
from furrow.sources.flavours import get_flavour
from furrow.sources.schemas import get_schema
from furrow.sources.tables import load, read_files, read_with_rejects


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV with a header, read with their schema and filtered."""
    o, path = load(spark, sf, "orders"), scratch_path(spark, "csv")
    o.write.option("header", True).csv(path)
    return read_files(spark, path, "csv", o.schema, header=True).where("o_totalprice > 300000 AND o_orderstatus <> 'P'")


def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, with all that their texts hold, as JSON lines and back."""
    d, path = load(spark, sf, "documents"), scratch_path(spark, "json")
    d.write.json(path)
    return read_files(spark, path, "json", d.schema).select("doc_id", "lang", "source", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


PART = "p_partkey bigint, p_name string, p_size int, p_retailprice decimal(12,2)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as CSV lines: of some the size is no number, others end early."""
    size = F.when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    price = F.format_string("%.2f", F.col("p_retailprice").cast("double"))
    whole = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_name"), size, price)
    return load(spark, sf, "part").select(F.when(F.col("p_partkey") % 11 == 0, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name"))
                                          .otherwise(whole).alias("value"))


def _both(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    good = rows.select(F.lit("row").alias("kind"), "p_partkey", "p_name", "p_size", "p_retailprice", F.lit(None).cast("string").alias("record"))
    return good.unionByName(rejects.select(F.lit("reject").alias("kind"), "parsed.p_partkey", "parsed.p_name", "parsed.p_size",
                                           "parsed.p_retailprice", "record"))


def csv_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bad-csv")
    _lines(spark, sf).write.text(path)
    return _both(*read_with_rejects(spark, path, "csv", PART))


def json_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as JSON lines, some cut off after the name."""
    path = scratch_path(spark, "bad-json")
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("p_retailprice"))
    line = F.to_json(F.struct(*p.columns))
    p.select(F.when(F.col("p_partkey") % 11 == 0, F.substring_index(line, ',"p_size', 1)).otherwise(line).alias("value")).write.text(path)
    rows, rejects = read_with_rejects(spark, path, "json", PART)
    return _both(rows, rejects).select("kind", F.when(F.col("kind") == "row", F.col("p_partkey")).alias("p_partkey"), "record")


def incremental_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders kept by year; the changes of two years are merged in place."""
    o, path = load(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate")), scratch_path(spark, "by-year")
    write_partitions(o, path, ["o_year"])
    changes = o.where("o_year IN (1994, 1996) AND o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = o.where("o_year = 1994 AND o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    merge_partitions(path, changes.unionByName(new), ["o_orderkey"], ["o_year"])
    return spark.read.parquet(path).select(*o.columns)


def search_bulk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as bulk files of a search store, and read back from them."""
    e, path = load(spark, sf, "events"), scratch_path(spark, "bulk")
    write_bulk(e, path, "events", 5_000)
    return read_bulk(spark, path, e.schema, "events")


def schema_types(spark: SparkSession, sf: str) -> DataFrame:
    """Each generated contact field: its type per store, and how many of the
    contacts (one per customer) fill it."""
    schema, rows = get_schema("contacts"), generated(spark, sf, "contacts")
    fields = [f.name for f in schema.generated_fields()]
    types = {d: dict(schema.sql_columns(d)) for d in ("postgres", "mysql", "duckdb")}
    filled = rows.agg(*[F.count(f).alias(f) for f in fields]).unpivot([], fields, "field", "filled")

    def named(d):
        return reduce(lambda c, f: c.when(F.col("field") == f, types[d][f]), fields, F).alias(d)

    return filled.select("field", *[named(d) for d in types], F.col("filled").cast("bigint").alias("filled"))


ALIASES = ["pg", "postgresql", "MySQL", "duck", "ES", "elastic"]


def flavour_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Customers offered twice to a store of each flavour, named by an alias."""
    c, out = load(spark, sf, "customer"), []
    for alias in ALIASES:
        store = Store(spark, scratch_path(spark, f"store-{alias.lower()}"), alias)
        store.create_if_absent("customer", c.schema, unique=[["c_custkey"]])
        store.insert("customer", c)
        report = store.insert("customer", c)
        out.append((alias, get_flavour(alias).name, report["offered"], report["inserted"], report["total"]))
    return spark.createDataFrame(out, "alias string, flavour string, offered bigint, inserted bigint, total bigint")


QUERIES = {
    "scan_csv": scan_csv,
    "scan_json": scan_json,
    "csv_bad_records": csv_bad_records,
    "json_bad_records": json_bad_records,
    "incremental_partitions": incremental_partitions,
    "search_bulk_files": search_bulk_files,
    "schema_types": schema_types,
    "flavour_loads": flavour_loads,
}

# The declared types of the contact fields.
_TYPES = {"first_name": "VARCHAR(100)", "last_name": "VARCHAR(100)", "email": "VARCHAR(255)", "phone": "VARCHAR(50)", "company": "VARCHAR(255)",
          "job_title": "VARCHAR(255)", "address": "VARCHAR(255)", "city": "VARCHAR(100)", "state": "VARCHAR(50)", "postal_code": "VARCHAR(20)",
          "country": "VARCHAR(100)", "created_at": "TIMESTAMP", "updated_at": "TIMESTAMP"}


def _types_sql() -> str:
    from furrow.plans.generate_pack import ORACLES as GENERATED
    one = "SELECT '{f}' AS field, '{p}' AS postgres, '{m}' AS mysql, '{p}' AS duckdb, count({f}) AS filled FROM i"
    return f"WITH i AS ({GENERATED['gen_contacts']}) " + " UNION ALL ".join(
        one.format(f=f, p=t, m="DATETIME" if t == "TIMESTAMP" else t) for f, t in _TYPES.items())


ORACLES = {
    "scan_csv": "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'P'",
    "scan_json": "SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5 FROM documents",
    "csv_bad_records": """WITH p AS (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part)
        SELECT 'row' AS kind, p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size, price AS p_retailprice, NULL::VARCHAR AS record
        FROM p WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0
        UNION ALL SELECT 'reject', p_partkey, p_name, NULL, CASE WHEN p_partkey % 11 <> 0 THEN price END,
               CASE WHEN p_partkey % 11 = 0 THEN p_partkey || ',' || p_name ELSE p_partkey || ',' || p_name || ',n/a,' || price END
        FROM p WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0""",
    "json_bad_records": """SELECT 'row' AS kind, p_partkey, NULL::VARCHAR AS record FROM part WHERE p_partkey % 11 <> 0
        UNION ALL SELECT 'reject', NULL, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"' FROM part WHERE p_partkey % 11 = 0""",
    "incremental_partitions": """WITH o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders)
        SELECT * REPLACE (CASE WHEN o_year IN (1994, 1996) AND o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM o
        UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM o WHERE o_year = 1994 AND o_orderkey % 5 = 0""",
    "search_bulk_files": "SELECT * FROM events",
    "schema_types": _types_sql(),
    "flavour_loads": " UNION ALL ".join(
        f"SELECT '{a}' AS alias, '{f}' AS flavour, count(*) AS offered, {'count(*)' if f == 'elasticsearch' else '0'}::BIGINT AS inserted, "
        f"{'2 * count(*)' if f == 'elasticsearch' else 'count(*)'}::BIGINT AS total FROM customer"
        for a, f in zip(ALIASES, ["postgres", "postgres", "mysql", "duckdb", "elasticsearch", "elasticsearch"])),
}
