"""Fold report: every metric of every fold, validation next to test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators import metrics, policy


def fold_metrics(df: DataFrame, by: Sequence[str] = ("fold_id",), threshold=0.03, split="split") -> DataFrame:
    """One row per fold from predicted rows of the splits `val` and `test`."""
    by = list(by)
    test = metrics.ranked(df.filter(F.col(split) == "test"), by)
    val = df.filter(F.col(split) == "val")
    q = metrics.quantile_analysis(test, by, p_value=False).drop("top_count", "bottom_count")
    tail = metrics.tail_metrics(test, by, threshold).drop("actual_up", "actual_down", "pred_up", "pred_down")
    out = metrics.point_metrics(test, by).withColumnRenamed("n", "n_test")
    for part in (
        metrics.information_coefficient(test, by).drop("n"), q, tail,
        policy.pooled_sharpe(test, by, threshold), policy.pooled_coverage(test, by),
    ):
        out = out.join(part, by)
    v = metrics.point_metrics(val, by).join(metrics.information_coefficient(val, by).drop("n"), by)
    v = v.select(*by, *[F.col(c).alias(f"val_{c}") for c in ("n", "rmse", "mae", "dir_acc", "ic")])
    return out.join(v, by, "left").withColumnRenamed("val_n", "n_val")
