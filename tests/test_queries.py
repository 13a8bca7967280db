"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from featherloom.queries import ORACLES, QUERIES
from tests.compare import assert_same
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_sanity_check_rounds_ties_as_sql(spark):
    """At this scale the mean of a slot is 25.40225."""
    folder = "/root/testdata/sf0.01"
    assert_same(QUERIES["sanity_check"](spark, folder), ORACLES["sanity_check"], folder)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - {"model_selection"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["key", "spent", "n_before", "errors"] and out.count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
