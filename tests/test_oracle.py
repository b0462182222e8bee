"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from rubrica.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    ok, note = compare(df, con, SQL[name])
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_registers_the_library():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
