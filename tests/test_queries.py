"""A cross-section of the registered queries against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["upsert_by_key", "calendar_align", "asof_monthly", "month_end_sample", "rolling_hurst", "rv_ratio", "forward_return",
         "walk_forward_folds", "fold_scaler", "ridge_fit_predict", "spearman_ic", "quantile_analysis", "regime_metrics",
         "evaluate_policy", "tune_threshold", "scenario_report", "feature_health", "stream_upsert"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert len(ours) and compare(ours, duck.sql(entry.oracle_sql()[name]).df()) == ""


def test_entry_has_rows_and_features(spark):
    df = entry.entry(spark)
    assert {"symbol", "date", "Hurst", "Target_1M"} <= set(df.columns) and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
