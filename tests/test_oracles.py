"""Every registered query against its SQL oracle in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def as_sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    answer = duck.execute(ORACLES[name])
    columns = [column[0] for column in answer.description]
    assert sorted(df.columns) == sorted(columns)
    got = as_sorted(df.columns, [tuple(row) for row in df.collect()])
    assert got == as_sorted(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
