"""Every registered query against its SQL twin on the smallest test folder."""

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    twin = TWINS.get(key)
    if twin is None:
        assert rows
        return
    cursor = con.execute(twin)
    found = difference((df.columns, rows), ([d[0] for d in cursor.description], cursor.fetchall()))
    assert found is None, found


def test_entry(spark):
    assert contract.entry(spark).count() > 0
