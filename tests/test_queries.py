"""Every registered query against its DuckDB oracle (sf0.001 here; the driver
checks sf0.01), and the flagship entry."""

import duckdb
import pytest

import __spark_entry__ as E
from furrow.plans import all_oracles, all_queries
from furrow.plans.compare import digest
from furrow.sources.tables import TABLES, table_path

SF_SMALL = "/root/testdata/sf0.001"

ORACLES = all_oracles()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(ORACLES)
    assert set(E.queries()) >= set(all_queries())


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_query_matches_oracle(spark, duck, key):
    df = all_queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLES[key])
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert types[f.name] == SPARK_TO_DUCK.get(t, t.upper()), (f.name, t, types[f.name])
    cur = duck.execute(ORACLES[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["customer_id", "name", "email", "orders", "revenue"]
