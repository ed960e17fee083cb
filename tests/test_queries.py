"""Registered queries against their checking SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from tabulon.plans.views import TABLES

CHECKED = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 5) + 0.0) if isinstance(v, float) else repr(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, con, name):
    df = contract.queries()[name](spark, sf)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert cells(df.columns, df.collect()) == cells(columns, cursor.fetchall())


def test_entry_finds_issues(spark):
    rows = contract.entry(spark).collect()
    assert {r["table_name"] for r in rows} == {"events", "orders_dirty"}


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
