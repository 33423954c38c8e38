"""Every query with an equivalent SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as driver
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


# Searches over whole grids take minutes, and need more rows than the smallest tables have; see test_models.
SEARCHES = {"logistic_cv", "forest_cv", "gbt_cv", "mlp_cv", "compare_models"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SEARCHES - {n for n in SQL if n.startswith("op") or n == "pipeline"}))
def test_query_equals_sql(spark, db, name):
    assert difference(QUERIES[name](spark, FOLDER), db, SQL[name]) is None


def test_entry(spark):
    first, second = driver.entry(spark), driver.entry(spark)
    assert first.schema == second.schema and first.count() > 0
