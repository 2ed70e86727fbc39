"""Every registered check against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from parcelry_checks.compare import difference, oracle_connection
from parcelry_checks.oracle import oracle_sql
from parcelry_checks.queries import drop_databases, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", queries())
def test_query(spark, connection, name):
    try:
        assert difference(queries()[name](spark, SF), connection, oracle_sql()[name]) is None
    finally:
        drop_databases(spark)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(__spark_entry__.queries())
