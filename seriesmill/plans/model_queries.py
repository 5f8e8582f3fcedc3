"""Queries of linear, gated, stacked and tree models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seriesmill.functions.columns import round6
from seriesmill.functions.lineage import written
from seriesmill.operators import linear, segments, splits, trees
from seriesmill.plans import panels
from seriesmill.plans.registry import query
from seriesmill.plans.split_queries import STATIC_ARGS, TUNED, WALK, WF, WF_ARGS, model_panel, tuning_rows, walk_panel, walk_rows
from seriesmill.plans.sqltext import FORECASTS, rounded
from seriesmill.operators.splits import walk_forward_folds

X = ["f1", "f2"]


def fit_cte(source: str, keys: str, out: str, alpha: str = "0", where: str = "split = 'train'", extra: str = "") -> str:
    """CTE `out(keys, w1, w2, b0)`: closed form of two-feature ridge."""
    return f"""{out}_s AS (SELECT {keys}{extra}, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(y_true) AS my,
    var_pop(f1) * count(*) + {alpha} AS a11, var_pop(f2) * count(*) + {alpha} AS a22, covar_pop(f1, f2) * count(*) AS a12,
    covar_pop(f1, y_true) * count(*) AS b1, covar_pop(f2, y_true) * count(*) AS b2 FROM {source} WHERE {where} GROUP BY {keys}{extra}),
{out}_w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM {out}_s),
{out} AS (SELECT *, my - w1 * m1 - w2 * m2 AS b0 FROM {out}_w)"""


def predicted(alpha: str) -> str:
    return rounded("SELECT symbol, date, fold_id, split, y_true, b0 + w1 * f1 + w2 * f2 AS y_pred FROM rows_ JOIN fit USING (fold_id)",
                   "symbol, date, fold_id, split", "y_true, y_pred", with_=WALK + ", " + fit_cte("rows_", "fold_id", "fit", alpha))


def _out(df, *more):
    return round6(df.select("symbol", "date", "fold_id", "split", "y_true", "y_pred", *more), "y_true", "y_pred")


@query("ols_fit_predict", predicted("0"))
def ols_fit_predict(spark, d):
    return _out(segments.walk_forward_predict(*walk_panel(spark, d), X, alpha=0.0, splits=("train", "val", "test")))


@query("ridge_fit_predict", predicted("10"))
def ridge_fit_predict(spark, d):
    return _out(segments.walk_forward_predict(*walk_panel(spark, d), X, alpha=10.0, splits=("train", "val", "test")))


ALPHAS = ", ".join(f"{a}::DOUBLE" for a in linear.ALPHA_GRID)


def f1(t: str, p: str) -> str:
    return (f"coalesce(2.0 * count(*) FILTER ({t} AND {p}) / nullif(count(*) FILTER ({t}) + count(*) FILTER ({p}), 0), 0)")


def alpha_sql(rows: str) -> str:
    return rounded(
        f"""SELECT fold_id, arg_min(alpha, (round(objective, 10), alpha)) AS best_alpha, min(objective) AS objective FROM (
      SELECT fold_id, alpha, avg((y_true - p) ** 2) - 0.5 * ({f1('y_true > 0.1', 'p > 0.1')} + {f1('y_true < -0.1', 'p < -0.1')}) AS objective
      FROM (SELECT fold_id, alpha, y_true, b0 + w1 * f1 + w2 * f2 AS p FROM rows_ JOIN fit USING (fold_id) WHERE split = 'val')
      GROUP BY fold_id, alpha) GROUP BY fold_id""",
        "fold_id, best_alpha", "objective",
        with_=rows + f", tr AS (SELECT * FROM rows_, (SELECT unnest([{ALPHAS}]) AS alpha) WHERE split = 'train'), "
        + fit_cte("tr", "fold_id", "fit", "alpha", extra=", alpha"))


@query("ridge_alpha_search", alpha_sql(WALK))
def ridge_alpha_search(spark, d):
    return round6(segments.walk_forward_alpha_search(*walk_panel(spark, d), X, threshold=0.1), "objective")


@query("tuned_alpha", alpha_sql(TUNED))
def tuned_alpha(spark, d):
    """The penalty search over the tuning folds."""
    return round6(linear.ridge_alpha_search(tuning_rows(spark, d), X, threshold=0.1), "objective")


GATED = WALK + """, med AS (SELECT fold_id, quantile_cont(f2, 0.5) AS threshold FROM rows_ WHERE split = 'train' GROUP BY fold_id),
sided AS (SELECT r.*, threshold, CASE WHEN f2 <= threshold THEN 0 ELSE 1 END AS side FROM rows_ r JOIN med USING (fold_id)), """


@query("regime_gated_ridge", rounded(
    "SELECT symbol, date, fold_id, split, CAST(side AS INTEGER) AS side, y_true, b0 + w1 * f1 + w2 * f2 AS y_pred FROM sided JOIN fit USING (fold_id, side)",
    "symbol, date, fold_id, split, side", "y_true, y_pred", with_=GATED + fit_cte("sided", "fold_id, side", "fit", "1")))
def regime_gated_ridge(spark, d):
    return _out(linear.regime_gated_ridge(walk_rows(spark, d), X, "f2"), "side")


@query("walk_forward_ridge", rounded(
    "SELECT symbol, fold_id, w1, w2, b0 FROM fit", "symbol, fold_id", "w1, w2, b0",
    with_=WF + """, xy AS (SELECT symbol, date, p, close / lag(close) OVER w - 1 AS f1, volume / 25 - 1 AS f2, lead(close) OVER w / close - 1 AS y_true
      FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    members AS (SELECT x.*, CAST(fold_id AS INTEGER) AS fold_id FROM xy x JOIN folds f ON x.symbol = f.symbol AND p BETWEEN train_lo AND train_hi), """
    + fit_cte("members", "symbol, fold_id", "fit", "1", "f1 IS NOT NULL AND y_true IS NOT NULL")))
def walk_forward_ridge(spark, d):
    from seriesmill.functions.columns import Series

    s = Series()
    p = panels.prices(spark, d)
    xy = p.withColumns({"f1": s.pct("close"), "f2": F.col("volume") / 25 - 1,
                        "y_true": s.lead("close", 1) / F.col("close") - 1})
    sums = linear.walk_forward_gram(xy, walk_forward_folds(p, **WF_ARGS), X, "y_true")
    fit = linear.solve(sums, 2, ["symbol", "fold_id"], (1.0,))
    out = fit.select("symbol", "fold_id", F.col("coef")[0].alias("w1"), F.col("coef")[1].alias("w2"), F.col("intercept").alias("b0"))
    return round6(out, "w1", "w2", "b0")


@query("feature_importance", rounded(
    "SELECT * FROM (SELECT fold_id, 'f1' AS feature, w1 AS importance FROM fit UNION ALL SELECT fold_id, 'f2', w2 FROM fit)"
    " ORDER BY importance DESC, feature, fold_id LIMIT 10", "fold_id, feature", "importance",
    with_=WALK + ", " + fit_cte("rows_", "fold_id", "fit", "1")))
def feature_importance(spark, d):
    return round6(linear.feature_importance(segments.walk_forward_fit(*walk_panel(spark, d), X), X, 10), "importance")


@query("gated_importance", rounded(
    "SELECT 'f1' AS feature, avg(w1) AS importance FROM fit UNION ALL SELECT 'f2', avg(w2) FROM fit", "feature", "importance",
    with_=GATED + fit_cte("sided", "fold_id, side", "fit", "1")))
def gated_importance(spark, d):
    coefs = linear.ridge_fit(linear.with_side(walk_rows(spark, d), "f2"), X, by=["fold_id", "side"])
    return round6(linear.mean_importance(coefs, X, ["fold_id", "side"]), "importance")


WEIGHTS = "CASE WHEN abs(y_true) > 0.1 THEN 5.0::DOUBLE ELSE 1.0 END"


@query("weighted_ridge", rounded(
    "SELECT fold_id, w1, w2, my - w1 * m1 - w2 * m2 AS b0 FROM w", "fold_id", "w1, w2, b0",
    with_=WALK + f""", t AS (SELECT *, {WEIGHTS} AS w FROM rows_ WHERE split = 'train'),
    m AS (SELECT fold_id, sum(w * f1) / sum(w) AS m1, sum(w * f2) / sum(w) AS m2, sum(w * y_true) / sum(w) AS my FROM t GROUP BY fold_id),
    s AS (SELECT fold_id, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, sum(w * (f1 - m1) ** 2) + 1 AS a11, sum(w * (f2 - m2) ** 2) + 1 AS a22,
      sum(w * (f1 - m1) * (f2 - m2)) AS a12, sum(w * (f1 - m1) * (y_true - my)) AS b1, sum(w * (f2 - m2) * (y_true - my)) AS b2 FROM t JOIN m USING (fold_id) GROUP BY fold_id),
    w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM s)"""))
def weighted_ridge(spark, d):
    """Rows with a big move count five times in the fit."""
    rows = splits.sample_weights(walk_rows(spark, d), threshold=0.1)
    fit = linear.ridge_fit(rows, X, weight="weight")
    return round6(fit.select("fold_id", F.col("coef")[0].alias("w1"), F.col("coef")[1].alias("w2"), F.col("intercept").alias("b0")), "w1", "w2", "b0")


@query("weighted_blend", rounded(
    """SELECT symbol, date, (0.3 * y_pred + CASE WHEN regime = 1 THEN 0.4 * -f1 ELSE 0 END + CASE WHEN fold_id % 2 = 0 THEN 0.3 * f2 ELSE 0 END)
       / (0.3 + CASE WHEN regime = 1 THEN 0.4 ELSE 0 END + CASE WHEN fold_id % 2 = 0 THEN 0.3 ELSE 0 END) AS blend FROM forecasts""",
    "symbol, date", "blend", with_=FORECASTS))
def weighted_blend(spark, d):
    f = panels.forecasts(spark, d)
    long = f.select("symbol", "date", F.inline(F.array(
        F.struct(F.lit("linear").alias("model"), F.col("y_pred").alias("y_pred")),
        F.struct(F.lit("second").alias("model"), F.when(F.col("regime") == 1, -F.col("f1")).alias("y_pred")),
        F.struct(F.lit("third").alias("model"), F.when(F.col("fold_id") % 2 == 0, F.col("f2")).alias("y_pred")))))
    return round6(linear.weighted_blend(long, {"linear": 0.3, "second": 0.4, "third": 0.3}), "blend")


LAMBDAS = "(SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS lam)"


def _stack(spark, d):
    return panels.forecasts(spark, d).withColumnsRenamed({"y_pred": "ridge_pred", "f1": "resid_pred"})


MIXED = FORECASTS + f""", mixed AS (SELECT symbol, date, lam, y_true, y_pred + lam * f1 AS y_pred FROM forecasts, {LAMBDAS}),
months AS (
  SELECT symbol, lam, avg(y_pred) FILTER (rn <= 5) AS y_pred, coalesce(max(nxt) FILTER (rn = 1), 0) AS y_true
  FROM (SELECT *, lead(y_true) OVER (PARTITION BY symbol, lam ORDER BY date) AS nxt,
          row_number() OVER (PARTITION BY symbol, lam, date_trunc('month', date) ORDER BY date DESC) AS rn FROM mixed)
  GROUP BY symbol, lam, date_trunc('month', date))"""


@query("stack_lambda_search", rounded(
    """SELECT symbol, coalesce(arg_min(lam, (round(-score, 10), lam)) FILTER (score IS NOT NULL), 0.0) AS best_lambda, max(score) AS best_score FROM (
      SELECT symbol, lam, CASE WHEN stddev_pop(r) = 0 THEN 0 ELSE avg(r) / stddev_pop(r) * sqrt(12) END AS score FROM (
        SELECT symbol, lam, sign(y_pred) * y_true AS r FROM months WHERE y_pred <> 0) GROUP BY symbol, lam) GROUP BY symbol""",
    "symbol, best_lambda", "best_score", with_=MIXED))
def stack_lambda_search(spark, d):
    return round6(linear.stack_lambda_search(_stack(spark, d), ["symbol"]), "best_score")


@query("stack_lambda_rmse", rounded(
    f"""SELECT fold_id, arg_min(lam, (round(rmse, 10), lam)) AS best_lambda, -min(rmse) AS best_score FROM (
      SELECT fold_id, lam, sqrt(avg((y_true - y_pred - lam * f1) ** 2)) AS rmse FROM forecasts, {LAMBDAS} GROUP BY fold_id, lam) GROUP BY fold_id""",
    "fold_id, best_lambda", "best_score", with_=FORECASTS))
def stack_lambda_rmse(spark, d):
    return round6(linear.stack_lambda_search(_stack(spark, d), ["fold_id"], "rmse"), "best_score")


def _least_squares(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def _apply(model, x):
    return np.column_stack([np.ones(len(x)), x]) @ model


@query("grouped_fit_predict", rounded(
    "SELECT symbol, date, fold_id, split, y_true, b0 + w1 * f1 + w2 * f2 AS y_pred FROM rows_ JOIN fit USING (symbol, fold_id)",
    "symbol, date, fold_id, split", "y_true, y_pred", with_=WALK + ", " + fit_cte("rows_", "symbol, fold_id", "fit")))
def grouped_fit_predict(spark, d):
    panel, folds = model_panel(spark, d)
    tasks = panels.tasks(spark, panel.count())
    return _out(linear.grouped_fit_predict(panel, _least_squares, _apply, X, by=("symbol", "fold_id"), folds=folds, tasks=tasks))


# --- trees: no SQL counterpart, checked by property tests -------------------
TREE_X = ["f1", "f2", "ret"]


def _rows(spark, d):
    """Forecast rows in an embargoed train, validation and test span of each series, written once: models read them several times."""
    return written(splits.static_split(panels.forecasts(spark, d), **STATIC_ARGS).drop("position"))


def _out_one(df, *more):
    return round6(df.select("symbol", "date", "split", "y_true", "y_pred", *more), "y_true", "y_pred")


@query("random_forest")
def random_forest(spark, d):
    return _out_one(trees.tree_fit_predict(_rows(spark, d), TREE_X, kind="random_forest"))


@query("gbt_regressor")
def gbt_regressor(spark, d):
    return _out_one(trees.tree_fit_predict(_rows(spark, d), TREE_X))


@query("tree_param_search")
def tree_param_search(spark, d):
    out = trees.tree_param_search(_rows(spark, d), TREE_X, {"maxDepth": [2, 4], "maxIter": [25, 50]}, threshold=0.1)
    return round6(out, "objective")


@query("bigmove_classifier")
def bigmove_classifier(spark, d):
    rows = _rows(spark, d).withColumn("label", F.when(F.abs("y_true") > 0.1, 1).otherwise(0))
    out = trees.bigmove_classifier(rows, TREE_X)
    return round6(out.select("symbol", "date", "split", "label", "pred", "prob"), "prob")


@query("regime_gated_hybrid")
def regime_gated_hybrid(spark, d):
    return _out_one(trees.regime_gated_hybrid(_rows(spark, d), TREE_X, "f2"), "side")


@query("trend_gated_hybrid")
def trend_gated_hybrid(spark, d):
    return _out_one(trees.trend_gated_hybrid(_rows(spark, d), TREE_X, "f1"), "side")


@query("residual_stack")
def residual_stack(spark, d):
    out = trees.residual_stack(_rows(spark, d), TREE_X)
    return round6(out.select("symbol", "date", "split", "y_true", "ridge_pred", "resid_pred", "lambda", "final_pred"),
                  "y_true", "ridge_pred", "resid_pred", "final_pred")
