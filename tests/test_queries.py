"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    rows = sorted(tuple(map(str, (row[i] for i in order))) for row in expected.fetchall())
    assert sorted(tuple(str(row[c]) for c in columns) for row in frame.collect()) == rows


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
