"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import support

SF = f"{support.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return support.oracle(SF)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = support.spark_rows(entry.queries()[name](spark, SF))
    want = support.sql_rows(con, entry.oracle_sql()[name])
    assert support.difference(got, want) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["dialogue_id", "outcome"]
