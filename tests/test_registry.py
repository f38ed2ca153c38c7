"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog.compare import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
SLOW = {"yield_model_evaluation"}  # fits models for minutes; test_decision covers the code


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
        return
    good, note = compare(df, con, sql)
    assert good, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
