"""Every query with SQL gives the SQL's rows on the smallest tables; every other query runs and keeps its schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

CORPUS = ("op", "pipeline")
NAMES = [n for n in entry.queries() if not n.startswith(CORPUS)]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names))))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SMALL).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(db.sql(sql).to_arrow_table())
    assert len(set(got.column_names)) == len(got.column_names)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
