"""Queries of the fold report and its summary."""

from __future__ import annotations

from seriesmill.functions.columns import round6
from seriesmill.operators import metrics, policy, reports, segments
from seriesmill.plans.registry import query
from seriesmill.plans.model_queries import X, fit_cte
from seriesmill.plans.split_queries import WALK, walk_panel
from seriesmill.plans.sqltext import POINT, position_sql, quantile_cte, rounded, spearman_cte, tail_select

SHARES = ", ".join(f"{p / 100.0}::DOUBLE" for p in policy.COVERAGE_PERCENTILES)


def _sharpe(name: str, t: str = "0.1") -> str:
    p = position_sql(name, t=t)
    r = f"({p}) * y_true"
    return f"avg({r}) FILTER (({p}) <> 0) / stddev_pop({r}) FILTER (({p}) <> 0) * sqrt(252)"


PREDICTED = WALK + ", " + fit_cte("rows_", "fold_id", "fit", "10") + """,
scored AS (SELECT symbol, date, fold_id, split, y_true, b0 + w1 * f1 + w2 * f2 AS y_pred FROM rows_ JOIN fit USING (fold_id) WHERE split <> 'train')"""
REPORT = PREDICTED + f""", test AS (SELECT * FROM scored WHERE split = 'test'), val AS (SELECT * FROM scored WHERE split = 'val'),
{spearman_cte("test", "fold_id", "tic")}, {quantile_cte("test", "fold_id", "tq")}, {spearman_cte("val", "fold_id", "vic")},
grid AS (SELECT fold_id, unnest(list_distinct(list_concat([0.0::DOUBLE], quantile_cont(abs(y_pred), [{SHARES}])))) AS threshold FROM test GROUP BY fold_id),
cov AS (SELECT fold_id, threshold, count(*) FILTER (p <> 0) / count(*)::DOUBLE AS coverage,
    avg(p * y_true) FILTER (p <> 0) / stddev_pop(p * y_true) FILTER (p <> 0) * sqrt(252) AS sharpe
  FROM (SELECT t.fold_id, threshold, y_true, {position_sql('thresholded', t='threshold')} AS p FROM test t JOIN grid USING (fold_id)) GROUP BY fold_id, threshold),
best AS (SELECT fold_id, arg_min(threshold, (round(-sharpe, 10), threshold)) AS best_threshold, arg_min(coverage, (round(-sharpe, 10), threshold)) AS best_coverage,
    max(sharpe) AS best_sharpe FROM cov WHERE coverage > 0.05 GROUP BY fold_id),
report AS (
  SELECT * FROM (SELECT fold_id, {POINT.replace("AS n,", "AS n_test,")} FROM test GROUP BY fold_id)
  JOIN (SELECT fold_id, ic FROM tic) USING (fold_id)
  JOIN (SELECT fold_id, spread, tstat, top_mean, bottom_mean, monotonicity FROM tq) USING (fold_id)
  JOIN (SELECT fold_id, {tail_select(0.1)} FROM test GROUP BY fold_id) USING (fold_id)
  JOIN (SELECT fold_id, {_sharpe('long_short')} AS strategy_sharpe, {_sharpe('thresholded')} AS big_move_sharpe FROM test GROUP BY fold_id) USING (fold_id)
  JOIN best USING (fold_id)
  LEFT JOIN (SELECT fold_id, n AS n_val, rmse AS val_rmse, mae AS val_mae, dir_acc AS val_dir_acc FROM (SELECT fold_id, {POINT} FROM val GROUP BY fold_id)) USING (fold_id)
  LEFT JOIN (SELECT fold_id, ic AS val_ic FROM vic) USING (fold_id))"""
VALUES = ("rmse, mae, dir_acc, ic, spread, tstat, top_mean, bottom_mean, monotonicity, precision_up, precision_down, recall_up, recall_down, "
          "strategy_sharpe, big_move_sharpe, best_threshold, best_coverage, best_sharpe, val_rmse, val_mae, val_dir_acc, val_ic")


def predicted_folds(spark, d):
    """Validation and test rows of every embargoed fold, predicted by the ridge of its training rows."""
    rows = segments.walk_forward_predict(*walk_panel(spark, d), X, alpha=10.0)
    return rows.select("symbol", "date", "fold_id", "split", "y_true", "y_pred")


@query("walk_forward_predict", rounded("SELECT * FROM scored", "symbol, date, fold_id, split", "y_true, y_pred", with_=PREDICTED))
def walk_forward_predict(spark, d):
    return round6(predicted_folds(spark, d), "y_true", "y_pred")


@query("fold_metrics", rounded("SELECT * FROM report", "fold_id, n_test, n_val", VALUES, with_=REPORT))
def fold_metrics(spark, d):
    return round6(reports.fold_metrics(predicted_folds(spark, d), threshold=0.1), *VALUES.split(", "))


MEANS = ["ic", "spread", "tstat", "monotonicity", "best_sharpe"]
VAL = ["val_rmse", "val_mae", "val_dir_acc", "val_ic"]
SUMMARY = [*[f"{c}_mean" for c in MEANS], *[f"{c}_std" for c in MEANS], "ic_spread_corr", *[f"{c}_mean" for c in VAL]]


@query("fold_summary", rounded(
    f"""SELECT count(*) AS n_folds, {", ".join(f"avg({c}) AS {c}_mean" for c in MEANS + VAL)}, {", ".join(f"stddev_pop({c}) AS {c}_std" for c in MEANS)},
        CASE WHEN count(*) > 3 THEN corr(ri, rs) END AS ic_spread_corr
        FROM (SELECT *, rank() OVER (ORDER BY ic) AS ri, rank() OVER (ORDER BY spread) AS rs FROM report)""",
    "n_folds", ", ".join(SUMMARY), with_=REPORT))
def fold_summary(spark, d):
    return round6(metrics.fold_summary(reports.fold_metrics(predicted_folds(spark, d), threshold=0.1)), *SUMMARY)
