"""Registered queries against their SQL twins on the smallest tables.

``python -m oracle.compare`` does the same for all of them at a larger scale.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle.compare import differences, duck
from oracle.queries import SQL

SF = "/root/testdata/sf0.001"
QUICK = (
    "canonical_names", "clean_domains", "row_count_audit", "joined", "sample_semi", "top_owners",
    "monthly_volume", "noise_summary", "tld_noise", "token_box", "dataset_summary",
    "request_features", "domain_history", "feature_matrix", "explain_top3", "greedy_select",
    "replay_ranked", "outcomes_view", "triage_view", "lead_time_summary", "detect_bursts",
    "watchlist", "stream_bursts", "stream_first_sightings", "greedy_select_fractional",
    "optimal_select_fractional", "explain_tree_top3", "predict_fixed", "scale_stats",
    "numeric_coercion", "model_choice", "joined_dirty", "feature_matrix_dirty", "replay_dirty",
    "domain_suffix_rules", "optimal_select_mixed", "tree_predict_fixed",
)
NAMES = list(SQL) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    rows, diff = differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert diff is None and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
