"""Registered queries against their SQL in DuckDB, at the smallest scale.

``ALL_QUERIES=1`` runs every query that has SQL; by default one in a family.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUICK = ["times_in_states", "seconds_since", "behavior_interval_mask", "state_epochs", "binned_speed", "tuning_curves",
         "mean_vector_length", "quantiles", "find_bimodal_threshold", "decoding_metrics", "circular_r", "putative_matches",
         "automated_labels", "align_channels_by_location", "shutter_close_times", "split_states", "drift_at_junctions",
         "gram", "auc", "population_vector", "find_turns", "fit_encoding_model", "theta_ratio", "wrap_through"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    status, *_ = check_oracles.check(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert status == "ok"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).columns == ["unit_id", "mvl", "pd", "peak"]
