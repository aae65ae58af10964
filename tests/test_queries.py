"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connection, difference, spark_rows, sql_rows
from registry import book

FOLDER = "/root/testdata/sf0.001"
NAMES = list(book.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sql, name):
    got = spark_rows(entry.queries()[name](spark, FOLDER))
    assert difference(got, sql_rows(sql, entry.oracle_sql()[name])) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
