"""Every query with SQL gives the second engine's rows, names and types."""

import pytest

import __spark_entry__ as entry
from comparing import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) == []


def test_entry(spark):
    result = entry.entry(spark)
    assert len(result.columns) == 18 and result.count() == 235
