"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from mnemoria.plans import registry

TABLES = "documents embeddings benchmark labels conversations events".split()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, name):
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    if name not in registry.SQL:
        assert rows
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted(map(repr, want.select(*columns).fetchall()))
