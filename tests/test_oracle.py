"""Every registered query equals its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from folioscope import catalog, oracle
from tests.compare import compare, duck
from tests.conftest import SMALL

QUERIES, SQL = catalog.QUERIES, oracle.all_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMALL, name, QUERIES[name], SQL[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
