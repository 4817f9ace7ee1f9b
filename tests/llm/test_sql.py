"""Text queries that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from playloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(columns).collect()) == rows([[r[k] for k in at] for r in want.fetchall()])
