"""Registered queries against DuckDB, and the plans they run as."""

import ast
import os
import re

import pytest
from check import compare, connect

import __spark_entry__ as entry
from revtide.plans.oracles import large_sql

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Long ones; `python tests/check.py <folder>` covers them.
SLOW = {
    "experiment_report", "graph_vertices", "graph_edges", "graph_self_loops", "graph_propagate", "graph_message_sum",
    "graph_logreg", "labelled_union", "rollup_editor", "combined_features", "rollup_user_article",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_matches_duckdb(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(large_sql()))
def test_large_results_match_duckdb(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, large_sql()[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["article_features", "editor_features", "directed_features", "politeness_markers"])
def test_hot_paths_hash_and_stay_in_the_jvm(spark, name):
    plan = _plan(spark, name)
    for word in ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in plan


def test_page_metrics_shuffles_its_rows_once(spark):
    plan = _plan(spark, "page_metrics")
    assert len(re.findall(r"Exchange hashpartitioning\(page_id#\d+L, _slice", plan)) == 1


def test_scans_read_few_columns(spark):
    plan = _plan(spark, "concentration_ratios")
    assert "event_type" not in plan and "value" not in plan.split("ReadSchema")[1][:80]


def test_library_has_no_python_functions_or_collects():
    banned = re.compile(r"\.(collect|toPandas|rdd|localCheckpoint|crossJoin|mapInPandas|applyInPandas)\b|pandas_udf|\budf\(")
    for folder, below, names in os.walk(os.path.join(ROOT, "revtide")):
        if "llm" in below:  # optional, with rules and tests of its own
            below.remove("llm")
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                ast.parse(text)
                assert not banned.search(text), name
