"""Loading into tables (K1-K8).

A ``Store`` is a folder of Parquet tables that Spark's catalog knows. Spark
writes, overwrites and commits them; what is added here are the rules of the
seed loader:

* **insert-ignore** (relational flavours): see ``conflicts``;
* **plain append** (search flavour): no key, duplicates kept;
* ids continue from ``max(id)`` in arrival order;
* NOT NULL, UNIQUE and FOREIGN KEY rules and string lengths travel with the
  table; a load checks them in the job that writes it;
* the load report (rows offered, inserted, rules broken) is observed in that
  job too, so no rows are counted again.
"""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.ids import dense_ids
from furrow.operators.conflicts import all_present, insert_ignore, insert_ignore_any
from furrow.operators.rules import ForeignKey, Rules, check_constraints
from furrow.session import materialize, path_exists
from furrow.sources.flavours import get_flavour

def assign_ids(accepted: DataFrame, order_cols: list[str], start_after: int = 0,
               id_col: str = "id") -> DataFrame:
    """K3: ids ``start_after + 1 ..`` in arrival order, first column."""
    with_id = dense_ids(accepted, order_cols, id_col=id_col, start=start_after + 1)
    return with_id.select(id_col, *accepted.columns)


def truncate_seconds(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """K7 (whole-second stores): truncate timestamps, keeping TIMESTAMP_NTZ
    (D10). Wall-clock times lose their fraction by interval arithmetic, so a
    session zone's clock changes cannot move them."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    out = df
    for c in cols:
        if isinstance(df.schema[c].dataType, T.TimestampNTZType):
            second = F.date_part(F.lit("SECOND"), F.col(c))
            cut = F.col(c) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second - F.floor(second))
        else:
            cut = F.date_trunc("second", F.col(c))
        out = out.withColumn(c, cut.cast(df.schema[c].dataType))
    return out


def _observed(observation: Observation) -> dict:
    """The metrics; none if adaptive execution cut the observed part out of the
    plan, which it does once it finds that part without rows."""
    try:
        return {k: int(v) for k, v in observation.get.items()}
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception.toString()):
            raise
        return {}


class Store:
    """Parquet tables below one folder, as a database of Spark's catalog.

    Each table has a history below ``_history``: its definition and one row per
    load. A session whose catalog does not keep names (the in-memory one) finds
    the table again by it. Loads are Spark appends; as with any such table, one
    load at a time writes it, and a load that fails leaves no rows.
    """

    HISTORY = "event string, definition string, rules string, offered bigint, inserted bigint, last_id bigint"

    def __init__(self, spark: SparkSession, root: str, flavour: str = "duckdb", id_mode: str = "dense"):
        """``id_mode``: ``dense`` numbers the accepted rows (no gaps);
        ``sequence`` behaves like the stores' sequences, where every offered
        row consumes an id and a skipped row leaves a gap."""
        if id_mode not in ("dense", "sequence"):
            raise ValueError("id_mode must be 'dense' or 'sequence'")
        self.spark, self.root, self.flavour, self.id_mode = spark, root.rstrip("/"), get_flavour(flavour), id_mode
        self.database = "furrow_" + hashlib.md5(self.root.encode()).hexdigest()[:16]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")

    # -- definition and history
    def _name(self, table: str) -> str:
        return f"{self.database}.`{table}`"

    def _history(self, table: str) -> DataFrame | None:
        path = f"{self.root}/_history/{table}"
        return self.spark.read.schema(self.HISTORY).parquet(path) if path_exists(self.spark, path) else None

    def _note(self, table: str, rows: list[tuple], mode: str = "append") -> None:
        self.spark.createDataFrame(rows, self.HISTORY).coalesce(1).write.mode(mode).parquet(f"{self.root}/_history/{table}")

    def _definition(self, table: str) -> tuple[str, Rules] | None:
        found = self._history(table)
        row = found.where("event = 'created'").first() if found is not None else None
        return (row.definition, Rules.from_json(row.rules)) if row else None

    def _register(self, table: str, definition: str) -> None:
        where = f"{self.root}/{table}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({definition}) USING parquet LOCATION '{where}'")

    def exists(self, table: str) -> bool:
        return self._definition(table) is not None

    def rules(self, table: str) -> Rules:
        return self._open(table)[1]

    def _open(self, table: str) -> tuple[str, Rules]:
        known = self._definition(table)
        if known is None:
            raise ValueError(f"table {table} does not exist; create it first")
        self._register(table, known[0])
        self.spark.catalog.refreshTable(self._name(table))
        return known

    # -- K1
    def create_if_absent(self, table: str, schema: T.StructType, unique: list[list[str]] | None = None,
                         foreign_keys: list[ForeignKey] = ()) -> bool:
        """``unique``: the unique keys; by default each field that its schema
        calls unique is one. Lengths of strings become VARCHAR."""
        if self.exists(table):
            return False

        def kind(f):
            n = f.metadata.get("max_len")
            return f"VARCHAR({n})" if n and isinstance(f.dataType, T.StringType) else f.dataType.simpleString()

        definition = ", ".join(f"`{f.name}` {kind(f)}" for f in schema.fields)
        self._register(table, definition)
        self._note(table, [("created", definition, Rules.of(schema, unique, foreign_keys).to_json(), 0, 0, None)])
        return True

    # -- reading, K4
    def read(self, table: str) -> DataFrame:
        self._open(table)
        return self.spark.table(self._name(table))

    def count(self, table: str) -> int:
        if not self.exists(table):
            if self.flavour.missing_table_counts_zero:
                return 0
            raise ValueError(f"table {table} does not exist")
        return self.read(table).count()

    def offered(self, table: str) -> int:
        """Rows offered to the table so far, as its loads noted them."""
        found = self._history(table)
        return int(found.agg(F.sum("offered")).first()[0] or 0) if found is not None else 0

    def max_id(self, table: str, id_col: str = "id") -> int:
        """The largest id given so far (0 for none): of the table's rows, and in
        ``sequence`` mode of skipped rows too."""
        top = self.read(table).agg(F.max(id_col)).first()[0] or 0
        if self.id_mode == "sequence":
            top = max(top, self._history(table).agg(F.max("last_id")).first()[0] or 0)
        return int(top)

    def violations(self, table: str) -> DataFrame:
        """K9: the table's own rules, checked over all its rows."""
        r = self.rules(table)
        return check_constraints(self.read(table), table, r.not_null, r.unique, [
            (k.columns, self.read(k.parent), k.parent_columns) for k in r.foreign_keys])

    # -- K2a, K2b, K3, K8
    def insert(self, table: str, df: DataFrame, unique_key: list[str] | None = None, order_cols: list[str] | None = None,
               id_col: str | None = None, offered: int | None = None, on_violation: str = "fail") -> dict:
        """Load ``df``; returns ``{"offered", "inserted", "total", "violations"}``.

        Rows go in by the table's unique keys, or by ``unique_key``. Rows that
        break a NOT NULL or FOREIGN KEY rule fail the load, or with
        ``on_violation="report"`` go in and are counted by rule. ``offered``
        overrides the observed number of rows offered.
        """
        definition, rules = self._open(table)
        keys = [list(unique_key)] if unique_key else [list(k) for k in rules.unique if set(k) <= set(df.columns)]
        if self.flavour.on_conflict == "append":
            keys = []
        rows = truncate_seconds(df) if self.flavour.whole_seconds else df
        arrival = order_cols or (keys[0] if keys else rows.columns[:1])
        top = self.max_id(table, id_col) if id_col else None
        last = None
        if id_col and self.id_mode == "sequence":
            rows = assign_ids(rows.drop(id_col), arrival, top, id_col)
            offered = rows.count() if offered is None else offered
            last = top + offered
        seen, written = Observation(), Observation()
        if len(keys) > 1:  # rows are numbered first, in jobs of their own
            offered = rows.count() if offered is None else offered
            rows = insert_ignore_any(self.read(table), rows, keys, arrival)
        elif keys:
            rows = insert_ignore(self.read(table), rows.observe(seen, F.count(F.lit(1)).alias("n")), keys[0], arrival)
        if id_col and self.id_mode == "dense":
            rows = assign_ids(rows.drop(id_col), arrival, top, id_col)
        rows, broken = self._checked(rows, rules)
        measures = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"v{i}") for i, c in enumerate(broken.values())]]
        if on_violation == "fail":
            for label, c in broken.items():
                rows = rows.where(F.when(c, F.raise_error(F.lit(f"{table}: {label} is violated")).cast("boolean")).otherwise(True))
        names = [f.name for f in self.spark.table(self._name(table)).schema.fields]
        rows.observe(written, *measures).select(*names).write.insertInto(self._name(table))
        got = _observed(written)
        inserted = got.get("n", 0)
        if offered is None:
            offered = _observed(seen).get("n", 0) if keys else inserted
        self._note(table, [("load", None, None, int(offered), inserted, last)])
        return {"offered": int(offered), "inserted": inserted, "total": self.count(table),
                "violations": {label: got.get(f"v{i}", 0) for i, label in enumerate(broken)}}

    def _checked(self, rows: DataFrame, rules: Rules) -> tuple[DataFrame, dict]:
        """``rows`` with what the checks need, and the condition of each break."""
        broken = {f"not null {c}": F.col(c).isNull() for c in rules.not_null if c in rows.columns}
        for i, k in enumerate(rules.foreign_keys):
            mark = f"_parent{i}"
            parent = self.read(k.parent).select(*[F.col(p).alias(c) for p, c in zip(k.parent_columns, k.columns)])
            parent = parent.where(all_present(list(k.columns))).distinct().withColumn(mark, F.lit(True))
            rows = rows.join(parent, list(k.columns), "left")
            broken[f"foreign key {','.join(k.columns)}"] = all_present(list(k.columns)) & F.col(mark).isNull()
        return rows, broken

    # -- full refresh, K5, K6
    def replace(self, table: str, df: DataFrame) -> None:
        """The rows of ``df`` become those of the table, which ``df`` may read."""
        if not self.create_if_absent(table, df.schema):
            self._open(table)
        names = [f.name for f in self.spark.table(self._name(table)).schema.fields]
        try:
            df.select(*names).write.insertInto(self._name(table), overwrite=True)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
                raise
            materialize(df.select(*names)).write.insertInto(self._name(table), overwrite=True)

    def truncate(self, table: str) -> None:
        if self.exists(table):
            self.replace(table, self.spark.createDataFrame([], self.read(table).schema))

    def drop(self, table: str) -> None:
        if self.exists(table):
            self.truncate(table)
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
            self._note(table, [], "overwrite")


def load_report(spark: SparkSession, report: dict) -> DataFrame:
    """K8: a load's report as (metric, value) rows."""
    rows = [(k, int(report[k])) for k in ("offered", "inserted", "total")]
    rows += [(f"violations of {k}", n) for k, n in report.get("violations", {}).items()]
    return spark.createDataFrame(rows, "metric string, value bigint")
