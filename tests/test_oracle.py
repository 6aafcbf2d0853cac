"""Registered queries against their SQL. TALLYRISK_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUICK = ["feat_engineered_table", "impute", "sample_weights", "dq_violations_defective", "dq_duplicate_ids",
         "inject_scores", "node_accounts", "node_devices", "edge_devices", "edge_shared_entities", "graph_sage_layer",
         "split_temporal_refined", "split_stratified", "metric_all", "metric_gates", "explain_top_contributors",
         "typed_layer", "contract_velocities", "contract_distinct_beneficiaries", "contract_pagerank",
         "contract_fan_out_month", "text_instruction_records", "stream_window_velocity"]
NAMES = list(entry.oracle_sql()) if os.environ.get("TALLYRISK_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, name):
    text, equal = compare(spark, connect(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert equal, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
