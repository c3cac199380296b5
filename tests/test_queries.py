"""Every registered query against its SQL on the smallest tables."""

import os

import compare
import pytest

from duolex import suite

SF = os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="module")
def database():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, database, name):
    assert compare.check(spark, database, SF, name, suite.QUERIES[name], suite.SQL.get(name)) == ""


def test_every_sql_has_a_query():
    assert set(suite.SQL) <= set(suite.QUERIES)
