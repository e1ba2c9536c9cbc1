"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import ROOT, SMALL

import __spark_entry__ as entry
from oracle import statements
from oracle.check import compare, duck
from vigilframe.plans import catalogue

# the queries of the library itself; those of the corpus operators have tests of their own
QUERIES, SQL = dict(catalogue.QUERIES), dict(statements.SQL)
# noise draws and fitted trees have no SQL statement
ROWS_ONLY = {"risk_scores", "unit_view_private", "federated_noised_average"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_a_statement():
    assert set(SQL) == set(QUERIES) - ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query(spark, con, name):
    ok, message = compare(QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df())
    assert ok, message


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    first = QUERIES[name](spark, SMALL)
    assert first.count() > 0 and len(set(first.columns)) == len(first.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and ROOT.exists()
