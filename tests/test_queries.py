"""Every registered query against its SQL on the small test tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402

from tidemart.plans.catalog import QUERIES  # noqa: E402
from tidemart.plans.oracle import ORACLE  # noqa: E402

BATCH = [name for name in QUERIES if not name.startswith("stream_")]


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{file}'")
    return con


def by_column(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", BATCH)
def test_query(spark, sf, engine, name):
    found = driver.queries()[name](spark, sf)
    cursor = engine.execute(driver.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    rows = by_column([tuple(row) for row in found.collect()], found.columns)
    assert rows, "a query without rows checks nothing"
    assert rows == by_column(cursor.fetchall(), columns)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
