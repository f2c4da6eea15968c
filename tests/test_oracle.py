"""Every query against its SQL on the driver's smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from paths import SMALL

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
