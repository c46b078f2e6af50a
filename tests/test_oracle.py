"""A part of the checked queries against DuckDB on small tables, with many small blocks."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SF = "/root/testdata/sf0.01"
NAMES = [
    "s2_sample_load", "j3_back_adjusted_series", "w13_later_total", "w9_forward_fill", "w18_evenly_spaced_rows", "e1_minute_features",
    "e4_multi_timeframe_features", "e6_classifier_features", "flagship_sma_cross_metrics", "m4_quadrant_mapping", "w16_trades",
    "a15_regime_metrics", "p6_stress_suite",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
