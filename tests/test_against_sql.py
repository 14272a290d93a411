"""Every registered query gives the rows that DuckDB gives for its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from tilltrail.checks.duckdb_sql import all_sql
from tilltrail.plans.registry import all_queries

FOLDER = f"{DATA}/sf{os.environ.get('TEST_SF', '0.001')}"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def _normal(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_matches_sql(spark, con, name):
    df = all_queries()[name](spark, FOLDER)
    cursor = con.execute(all_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _normal(df.columns, df.collect()) == _normal(columns, cursor.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
