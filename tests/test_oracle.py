"""Every query against its SQL, over the whole tables of the smallest data directory."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# the library's own queries; those over document tables have tests of their own
QUERIES = {name: query for name, query in entry.queries().items() if name in entry.catalog()}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
SLOW = {"challenger_gbt", "feature_importance", "score_both", "model_comparison_fitted"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 84
