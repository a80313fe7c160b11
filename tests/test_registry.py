"""Entry points and the plans of all registered queries."""

from __future__ import annotations

import importlib
import re
import sys

import pytest

from rillstone.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0 and "discharge_cfs_mean_z" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)


def test_queries_without_an_optional_package(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [m for m in sys.modules if m.startswith("rillstone.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


# Models fit when a query is built, which takes long; their plans are not looked at here.
FITTED = {
    "text_bayes", "text_classify", "word2vec", "lda_topics", "als", "als_text_keys", "kmeans", "bisecting_kmeans", "pca", "pca_reconstruction",
    "linear_models", "logistic_balanced", "linear_svm", "mlp", "decision_tree", "random_forest", "gradient_boosting",
    "permutation_importance", "partial_dependence", "frequent_itemsets", "closed_itemsets", "association_rules", "sequential_patterns",
    "dbscan", "lof", "knn_classify", "isolation_forest", "streaming_daily", "silhouette",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_plan_has_no_crossing(spark, name):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("BatchEvalPython|CollectLimit", text)


def test_pruning_and_pushdown(spark):
    text = QUERIES["time_range"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text
    text = QUERIES["parquet_pruned"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_flagship_needs_two_exchanges(spark):
    df = QUERIES["rolling_anomaly_z"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2 and text.count("FileScan") == 1


def test_sql_covers_most_queries():
    assert len(ORACLES) > 0.7 * len(QUERIES)


def test_scores_over_whole_rows_with_empty_days(spark):
    df = QUERIES["rolling_anomaly_z_empty_days"](spark, SMALL.replace("sf0.001", "sf0.01"))
    whole = QUERIES["daily_features_holes"](spark, SMALL.replace("sf0.001", "sf0.01"))
    assert df.count() == whole.count() and df.select(whole.columns).exceptAll(whole).count() == 0
    assert df.filter("stage_ft_mean IS NULL").count() > 0 and df.filter("stage_ft_mean_z IS NOT NULL").count() > 0
    assert "rolling_anomaly_z_empty_days" in ORACLES
