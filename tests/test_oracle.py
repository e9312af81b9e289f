"""Every registered query against its SQL twin on the given tables."""

import pytest

import __spark_entry__ as entry
from harness import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
