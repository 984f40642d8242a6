"""Every query with SQL agrees with DuckDB; every other runs and has rows."""

import pytest
from oracle import rows_of, rows_of_sql

import __spark_entry__ as entry
from frond.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SMALL)) == rows_of_sql(registry.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert not registry.QUERIES[name](spark, SMALL).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_type", "l_partkey", "health_index", "percentile", "level"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
