"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare

NAMES = sorted(E.core_queries())


def test_every_query_has_an_oracle():
    assert set(E.core_oracle_sql()) == set(E.core_queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["performance_category", "number_of_measures", "percentage"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def report(spark, sf001):
    return compare(spark, sf001, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(report, name):
    r = report[name]
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r
