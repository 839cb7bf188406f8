"""Sinks (K1-K9, S4): insert-ignore, ids, table lifecycle, rules, flavours."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import conflicts as C
from furrow.operators import sink as K
from furrow.operators.rules import ForeignKey, Rules, check_constraints
from furrow.sources import flavours as S


def test_flavours_and_aliases():
    assert S.get_flavour("PG").name == "postgres"
    assert S.get_flavour("postgresql").name == "postgres"
    assert S.get_flavour("es").name == "elasticsearch"
    assert S.get_flavour("Elastic").name == "elasticsearch"
    assert S.get_flavour("duck").name == "duckdb"
    with pytest.raises(ValueError, match="no store flavour"):
        S.get_flavour("oracle")
    norm, warn = S.resolve_normalize(S.get_flavour("es"), True)
    assert norm is False and "flat" in warn
    assert S.resolve_normalize(S.get_flavour("mysql"), True) == (True, None)


def test_list_flavours():
    assert S.list_flavours() == [("postgres", True), ("mysql", True), ("duckdb", True),
                                 ("elasticsearch", False)]


# ---------------------------------------------------------------- insert-ignore


def test_insert_ignore_batch_and_existing(spark):
    existing = spark.createDataFrame([("A", 1), ("B", 2)], ["k", "seq"])
    incoming = spark.createDataFrame([("A", 3), ("C", 5), ("C", 4), (None, 6), (None, 7), (None, 7)], ["k", "seq"])
    got = sorted(C.insert_ignore(existing, incoming, "k", ["seq"]).collect(), key=lambda r: r.seq)
    assert [(r.k, r.seq) for r in got] == [("C", 4), (None, 6), (None, 7), (None, 7)]


def test_insert_ignore_reads_its_input_once_and_aggregates_first(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = C.insert_ignore(li, li, ["l_orderkey", "l_linenumber"], ["l_partkey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "partial_min_by" in plan  # the input, and the keys of the table


def row_by_row(existing, rows, keys):
    """Keys are lists of places in a row; rows come in arrival order."""
    taken = [{tuple(r[i] for i in k) for r in existing} for k in keys]
    out = []
    for r in rows:
        values = [tuple(r[i] for i in k) for k in keys]
        if not any(None not in v and v in t for v, t in zip(values, taken)):
            out.append(r)
            for v, t in zip(values, taken):
                t.add(v)
    return out


THREE = [["a"], ["b"], ["a2", "b2"]]
PLACES = [[1], [2], [3, 4]]
SCHEMA = "seq int, a int, b int, a2 int, b2 int"


def accepted(spark, existing, rows, tail, parts=3):
    old = spark.createDataFrame(existing, SCHEMA) if existing else None
    new = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in C.insert_ignore_any(old, new, THREE, ["seq"], tail).collect()), key=str)


value = st.one_of(st.none(), st.integers(0, 5))
some_rows = st.lists(st.tuples(value, value, value, value), max_size=24)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(some_rows.filter(lambda r: len(r) < 5), some_rows, st.sampled_from([0, 3, 1000]))
def test_several_keys_equal_a_row_by_row_load(spark, existing, rows, tail):
    existing = row_by_row([], [(i, *r) for i, r in enumerate(existing)], PLACES)
    rows = [(100 + i, *r) for i, r in enumerate(rows)]
    assert accepted(spark, existing, rows, tail) == sorted(row_by_row(existing, rows, PLACES), key=str)


def test_several_keys_on_lineitem_equal_a_row_by_row_load(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    keys = [["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]]
    order = [c for c in li.columns if c not in keys[0]]
    rows = [tuple(r) for r in li.orderBy(*order, *keys[0]).collect()]
    want = row_by_row([], rows, [[li.columns.index(c) for c in k] for k in keys])
    got = C.insert_ignore_any(None, li.repartition(7), keys, order)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_chain_of_conflicts_and_a_hot_key(spark):
    """Each row of the chain shares a key with its neighbours, so every other
    one goes in; a third of the other rows share one value."""
    chain = [(i, (i + 1) // 2, 1000 + i // 2, None, None) for i in range(60)]
    rng = random.Random(1)
    rest = [(100 + i, -1 if i % 3 == 0 else 5000 + rng.randrange(900), 9000 + i, i % 7, i % 11) for i in range(900)]
    want = sorted(row_by_row([], chain + rest, PLACES), key=str)
    assert accepted(spark, [], chain + rest, 5) == want
    assert accepted(spark, [], chain + rest, 10_000) == want
    assert sum(r[0] < 60 for r in want) == 30


def test_several_keys_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.insert_ignore_any(None, empty, THREE, ["seq"]).collect() == []
    assert C.insert_ignore_any(empty, empty, THREE, ["seq"], 0).collect() == []


# ---------------------------------------------------------------- rows


def test_assign_ids_continue(spark):
    df = spark.createDataFrame([(10,), (5,), (7,)], ["seq"])
    got = K.assign_ids(df, ["seq"], start_after=41).orderBy("id").collect()
    assert [(r.id, r.seq) for r in got] == [(42, 5), (43, 7), (44, 10)]


def test_truncate_seconds_keeps_ntz(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 5, 999999),)], "ts timestamp_ntz")
    out = K.truncate_seconds(df)
    assert out.schema["ts"].dataType.simpleString() == "timestamp_ntz"
    assert out.first().ts == dt.datetime(2024, 1, 1, 10, 0, 5)


# ---------------------------------------------------------------- the store


def test_store_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    store = K.Store(spark, root, "duckdb")
    schema = "id bigint, email string, n int"
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (None, "a", 3)], schema)
    assert store.create_if_absent("t", df.schema) and not store.create_if_absent("t", df.schema)
    r = store.insert("t", df, unique_key=["email"], order_cols=["n"], id_col="id")
    assert (r["offered"], r["inserted"], r["total"]) == (3, 2, 2)
    r = store.insert("t", spark.createDataFrame([(None, "a", 9), (None, "c", 8)], schema),
                     unique_key=["email"], order_cols=["n"], id_col="id")
    assert (r["offered"], r["inserted"], r["total"]) == (2, 1, 3)
    assert {x.email: x.id for x in store.read("t").collect()} == {"a": 1, "b": 2, "c": 3}
    store.truncate("t")
    assert store.count("t") == 0 and store.exists("t")
    store.replace("t", spark.createDataFrame([(1, "z", 0)], schema))
    assert store.count("t") == 1
    store.replace("t", store.read("t").unionByName(store.read("t")))  # reads what it replaces
    assert store.count("t") == 2
    store.drop("t")
    assert not store.exists("t")
    with pytest.raises(ValueError):
        store.count("t")
    assert K.Store(spark, root, "es").count("t") == 0   # search flavour: missing -> 0
    store.create_if_absent("t", spark.createDataFrame([], "other string").schema)
    assert store.read("t").columns == ["other"] and store.offered("t") == 0


def test_nothing_offered(spark, tmp_path):
    store = K.Store(spark, str(tmp_path))
    df = spark.createDataFrame([], "id bigint, k string")
    store.create_if_absent("t", df.schema)
    for key in (["k"], None):
        r = store.insert("t", df, unique_key=key, id_col="id")
        assert (r["offered"], r["inserted"], r["total"]) == (0, 0, 0)


def test_a_later_session_finds_the_table_and_its_rules(spark, tmp_path):
    rules = [["sku"], ["code"]]
    one = K.Store(spark, str(tmp_path), "postgres")
    schema = T.StructType([T.StructField("sku", T.StringType(), False, {"max_len": 3}), T.StructField("code", T.IntegerType())])
    one.create_if_absent("p", schema, unique=rules)
    one.insert("p", spark.createDataFrame([("a", 1), ("b", 2)], "sku string, code int"))
    spark.sql(f"DROP TABLE {one._name('p')}")  # as in a session whose catalog kept no names
    two = K.Store(spark, str(tmp_path), "postgres")
    assert two.rules("p") == Rules(("sku",), (("sku",), ("code",)))
    r = two.insert("p", spark.createDataFrame([("c", 1), ("a", 9), ("c", 3), ("d", 3)], "sku string, code int"), order_cols=["sku", "code"])
    assert (r["offered"], r["inserted"], r["total"]) == (4, 1, 3)  # (c, 1) and (a, 9) conflict, (d, 3) with (c, 3)
    assert sorted(tuple(x) for x in two.read("p").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        two.insert("p", spark.createDataFrame([("long", 7)], "sku string, code int"))
    assert two.count("p") == 3


def test_rules_fail_a_load_or_are_counted(spark, tmp_path):
    store = K.Store(spark, str(tmp_path), "postgres")
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    store.create_if_absent("parent", parent.schema)
    store.insert("parent", parent)
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("fk", T.IntegerType()),
                           T.StructField("name", T.StringType(), False)])
    store.create_if_absent("c", schema, unique=[["k"]], foreign_keys=[ForeignKey(("fk",), "parent", ("pk",))])
    good = spark.createDataFrame([(1, 1, "x"), (2, None, "y")], "k int, fk int, name string")
    assert store.insert("c", good)["violations"] == {"not null k": 0, "not null name": 0, "foreign key fk": 0}
    for bad, what in (((3, 9, "x"), "foreign key fk"), ((4, 1, None), "not null name")):
        with pytest.raises(Exception, match=what):
            store.insert("c", spark.createDataFrame([(5, 1, "fine"), bad], good.schema))
        assert store.count("c") == 2
    r = store.insert("c", spark.createDataFrame([(3, 9, None), (4, 8, "z"), (1, 7, None)], good.schema), on_violation="report")
    assert (r["offered"], r["inserted"], r["total"]) == (3, 2, 4)
    assert r["violations"] == {"not null k": 0, "not null name": 1, "foreign key fk": 2}
    found = {(x.constraint, x.columns): x.violations for x in store.violations("c").collect()}
    assert found == {("not_null", "k"): 0, ("not_null", "name"): 1, ("unique", "k"): 0, ("foreign_key", "fk"): 2}


def test_the_report_costs_no_count_of_the_input(spark, tmp_path):
    """One job group: the load's write, the listing of the table's footers."""
    store = K.Store(spark, str(tmp_path), "postgres")
    df = spark.createDataFrame([(i % 50, i) for i in range(200)], "k int, v int").repartition(4)
    store.create_if_absent("t", df.schema, unique=[["k"]])
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(v):
        reads.add(1)
        return v

    r = store.insert("t", df.select("k", seen("v").alias("v")), order_cols=["v"])
    assert (r["offered"], r["inserted"], r["total"]) == (200, 50, 50) and reads.value == 200


def test_search_flavour_appends_duplicates(spark, tmp_path):
    store = K.Store(spark, str(tmp_path), "elasticsearch")
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    store.create_if_absent("idx", df.schema, unique=[["k"]])
    assert store.insert("idx", df)["inserted"] == 2


def test_mysql_flavour_truncates_seconds(spark, tmp_path):
    store = K.Store(spark, str(tmp_path), "mysql")
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 1, 1, 1, 500))], "k string, ts timestamp_ntz")
    store.create_if_absent("t", df.schema)
    store.insert("t", df, unique_key=["k"])
    assert store.read("t").first().ts == dt.datetime(2024, 1, 1, 1, 1, 1)


def test_sequence_ids_leave_gaps_like_store_sequences(spark, tmp_path):
    """Reference stores: every offered row consumes an id; skipped rows leave gaps."""
    store = K.Store(spark, str(tmp_path), "postgres", id_mode="sequence")
    schema = "k string, n int"
    store.create_if_absent("t", spark.createDataFrame([], "id bigint, k string, n int").schema)
    for rows in ([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("c", 5)], [("c", 6), ("d", 7)]):
        store.insert("t", spark.createDataFrame(rows, schema), unique_key=["k"], order_cols=["n"], id_col="id")
    assert sorted((r.id, r.k) for r in store.read("t").collect()) == [(1, "a"), (2, "b"), (4, "c"), (7, "d")]
    with pytest.raises(ValueError):
        K.Store(spark, str(tmp_path), "duckdb", id_mode="nope")


def test_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    child = spark.createDataFrame([(1, 1), (1, 2), (2, None), (3, 9)], "k int, fk int")
    got = {(r.constraint, r.columns): r.violations for r in check_constraints(
        child, "c", not_null=["fk"], unique=[["k"]], foreign_keys=[(["fk"], parent, ["pk"])]).collect()}
    assert got == {("not_null", "fk"): 1, ("unique", "k"): 1, ("foreign_key", "fk"): 1}
    assert check_constraints(child, "c").collect() == []
