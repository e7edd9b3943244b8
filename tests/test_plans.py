"""Plan shape: what must hold at any size."""

import re

import pytest

from voltpanel.operators import features, keyed
from voltpanel.plans import fixtures as fx
from voltpanel.plans.catalog import QUERIES
from voltpanel.sources import feeds


def plan(frame) -> str:
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


LAZY = [
    "impute_ratio", "modelling_table", "featureset_inference", "live_demand_features", "inference_row", "upsert_demand",
    "upsert_prediction", "merge_sources_keep_newest", "trailing_scores", "regime_correlation", "autocorrelation",
    "alignment_audit", "cv_folds",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_row_code(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_feature_chain_shuffles_by_zone_once(spark, sf_dir):
    table = features.feature_set(fx.modelling(spark, sf_dir), "inference")
    assert len(re.findall(r"Exchange hashpartitioning\(zone#\d+, \d+\)", plan(table))) == 1


def test_imputation_adds_no_shuffle_of_its_own(spark, sf_dir):
    text = plan(fx.imputed(spark, sf_dir))
    by_zone = re.findall(r"Exchange hashpartitioning\(zone#\d+, \d+\)", text)
    assert len(by_zone) == 1


def test_date_predicate_and_columns_reach_the_scan(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    text = plan(feeds.since(lines, "2000-01-01", "l_shipdate"))
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01T00:00" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in text
    demand = plan(fx.demand_raw(spark, sf_dir))
    assert "struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in demand


def test_dedup_reduces_before_it_shuffles(spark, make_panel):
    text = plan(keyed.keep_newest(make_panel({"a": [1, 2]}), ["zone"], ["period"]))
    assert "partial_max_by" in text and "Window" not in text
