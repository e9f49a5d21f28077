"""Each registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from strataudit.plans import oracles, queries as catalogue
from tests.check_sql import compare, tables_in

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables_in(FOLDER)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
