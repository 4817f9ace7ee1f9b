"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from playloom import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.9g}" if isinstance(value, (int, float)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE_SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "playloom", tmp_path / "playloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
