"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from stratawork.plans import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    problem = differences(df, duck, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
