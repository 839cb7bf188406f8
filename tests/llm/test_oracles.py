"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from furrow.llm import registry
from furrow.plans.compare import digest
from furrow.sources.tables import TABLES, table_path

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMALL, t)}')")
    df = registry.queries()[key](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(registry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]
