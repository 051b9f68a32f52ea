"""Every query with a SQL counterpart agrees with it on the smallest data."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    assert compare(queries()[name](spark, FOLDER), duck, ORACLES[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())
