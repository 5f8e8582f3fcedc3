"""Forecast metrics per group (fold, run, regime, year, model).

Groups may be of any size: everything is an aggregate that combines before the
shuffle, or a chunked rank.  Rows with a missing or non-finite value are left
out first.  `is_series=True` promises groups bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import clip, corr, count_if, divide, finite, mean_if, safe_ratio, share
from seriesmill.operators.ranking import average_rank, quantile_bin, spearman, with_rank, with_ranks


def usable(df: DataFrame, *columns: str) -> DataFrame:
    columns = columns or ("y_true", "y_pred")
    return df.filter(reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in columns]))


def point_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and percent of equal signs (0 equals 0)."""
    e = F.col("y_true") - F.col("y_pred")
    return usable(df).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100.0 * share(F.signum("y_true") == F.signum("y_pred"))).alias("dir_acc"),
    )


def loss_metrics(df, by=(), delta=1.0, alpha=4.0, threshold=0.03) -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    huber = F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    weight = F.when(F.abs("y_true") > threshold, 1.0 + alpha).otherwise(1.0)
    return usable(df).groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.avg(huber).alias("huber"), F.avg(weight * e * e).alias("tail_weighted")
    )


def ranked(df, by, is_series=False, both=True) -> DataFrame:
    """Usable rows with the rank columns `p_*` of forecasts and `t_*` of actuals.

    Rows ranked before (by the same groups) are taken as they are, so that
    several metrics can share one ranking.
    """
    wanted = {"p": "y_pred", "t": "y_true"} if both else {"p": "y_pred"}
    wanted = {p: c for p, c in wanted.items() if f"{p}_below" not in df.columns}
    return with_ranks(usable(df), wanted, by, is_series=is_series) if wanted else df


def information_coefficient(df, by, is_series=False) -> DataFrame:
    """Spearman correlation with average ranks; undefined counts as 0."""
    return ranked(df, by, is_series).groupBy(*by).agg(
        F.count("*").alias("n"), spearman("t", "p").alias("ic")
    )


def hit_rate_of(true: Column, pred: Column) -> Column:
    """Aggregate: share of equal signs among rows that moved; none gives 0."""
    return F.coalesce(
        F.avg(F.when(true != 0, F.when(F.signum(true) == F.signum(pred), 1.0).otherwise(0.0))),
        F.lit(0.0),
    )


def hit_rate(df, by=()) -> DataFrame:
    return usable(df).groupBy(*by).agg(hit_rate_of(F.col("y_true"), F.col("y_pred")).alias("hit_rate"))


def classification_stats(df, by=(), ratio=safe_ratio) -> DataFrame:
    """Direction as a classifier: positive means above zero.

    `ratio` says what a share of nothing is: 0, or NaN with `float_ratio`.
    """
    t, p = F.col("y_true") > 0, F.col("y_pred") > 0
    c = usable(df).groupBy(*by).agg(
        count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"),
        count_if(~t & ~p).alias("tn"), count_if(t & ~p).alias("fn"), F.count("*").alias("n"),
    )
    c = c.withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), "n"),
            "precision_up": ratio("tp", F.col("tp") + F.col("fp")),
            "recall_up": ratio("tp", F.col("tp") + F.col("fn")),
            "precision_down": ratio("tn", F.col("tn") + F.col("fn")),
            "recall_down": ratio("tn", F.col("tn") + F.col("fp")),
        }
    )
    return c.withColumn("f1_up", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def _quantile_bins(df, by, bins, is_series) -> DataFrame:
    r = ranked(df, by, is_series, both=False)
    n = F.col("p_total")
    used = F.when(n >= 2 * bins, bins).when(n >= 10, 5).when(n >= 4, 2)
    return r.withColumn("_bin", F.coalesce(quantile_bin("p", used), F.lit(0))).groupBy(*by, "_bin").agg(
        F.count("*").alias("count"),
        F.avg("y_true").alias("mean_return"),
        F.var_samp("y_true").alias("_var"),
        F.max(F.when(used.isNotNull(), 1).otherwise(0)).alias("_enough"),
    )


def quantile_returns(df, by, bins=10, is_series=False) -> DataFrame:
    """Mean return and count per prediction quantile, lowest first."""
    along = Window.partitionBy(*by).orderBy("_bin")
    return (
        _quantile_bins(df, by, bins, is_series)
        .filter("_enough = 1")
        .select(*by, (F.row_number().over(along) - 1).alias("quantile"), "count", "mean_return")
    )


def quantile_analysis(df, by, bins=10, is_series=False, p_value=True) -> DataFrame:
    """Top minus bottom quantile with pooled t test and monotonicity.

    Bins fall back from `bins` to 5 and 2 for small groups; below 4 rows all
    results are 0.  Merged edges leave fewer bins, which are numbered densely.
    """
    group = Window.partitionBy(*by)
    b = _quantile_bins(df, by, bins, is_series).withColumns(
        {
            "_label": F.row_number().over(group.orderBy("_bin")) - 1,
            "_k": F.count("*").over(group),
            "_rank": F.rank().over(group.orderBy("mean_return")),
            "_ties": F.count("*").over(Window.partitionBy(*by, "mean_return")),
        }
    )
    top, low = F.col("_label") == F.col("_k") - 1, F.col("_label") == 0

    def at(cond, c):
        return F.max(F.when(cond, F.col(c)))

    k = F.max("_k")
    mono = corr(F.col("_label").cast("double"), F.col("_rank") + (F.col("_ties") - 1) / 2.0)
    s = b.groupBy(*by).agg(
        at(top, "mean_return").alias("top_mean"), at(low, "mean_return").alias("bottom_mean"),
        at(top, "count").alias("top_count"), at(low, "count").alias("bottom_count"),
        at(top, "_var").alias("_v1"), at(low, "_var").alias("_v2"),
        F.max("_enough").alias("_enough"),
        F.when(k >= 3, F.coalesce(mono, F.lit(0.0)))
        .when((k == 2) & (at(top, "mean_return") > at(low, "mean_return")), 1.0)
        .when(k == 2, -1.0)
        .otherwise(0.0)
        .alias("monotonicity"),
    )
    n1, n2 = F.col("top_count"), F.col("bottom_count")
    pooled = divide((n1 - 1) * F.col("_v1") + (n2 - 1) * F.col("_v2"), n1 + n2 - 2)
    error = F.sqrt(pooled * (1 / n1 + 1 / n2))
    t = F.when((n1 > 1) & (n2 > 1), divide(F.col("top_mean") - F.col("bottom_mean"), error))
    s = s.withColumns(
        {"spread": F.col("top_mean") - F.col("bottom_mean"), "tstat": F.coalesce(t, F.lit(0.0)),
         "_dof": F.when(t.isNotNull(), n1 + n2 - 2)}
    )
    enough = F.col("_enough") == 1
    doubles = ["spread", "tstat", "top_mean", "bottom_mean", "monotonicity"]
    out = s.select(
        *by,
        *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in doubles],
        *[F.when(enough, F.col(c)).otherwise(0).alias(c) for c in ("top_count", "bottom_count")],
        *([F.when(enough, t_p_value()(F.col("tstat"), F.col("_dof").cast("double"))).otherwise(1.0).alias("pvalue")]
          if p_value else []),
    )
    return out


def student_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t (continued fraction of the beta integral)."""
    from math import lgamma

    out = np.ones(len(t))
    for i, (x, v) in enumerate(zip(t, dof)):
        if not np.isfinite(v) or v <= 0:
            continue
        a, b, z = v / 2.0, 0.5, v / (v + x * x)
        if z >= 1.0:
            continue
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(z) + b * np.log1p(-z))
        swap = z > (a + 1.0) / (a + b + 2.0)
        if swap:
            a, b, z = b, a, 1.0 - z
        c, d = 1.0, 1.0 / (1.0 - (a + b) * z / (a + 1.0))
        h = d
        for m in range(1, 500):
            for num in (
                m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 / (1.0 + num * d)
                c = 1.0 + num / c
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        value = front * h / a
        out[i] = 1.0 - value if swap else value
    return out


def t_p_value():
    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series(student_p(t.to_numpy(float), dof.to_numpy(float)))

    return p


def decile_spread(df, by, is_series=False) -> DataFrame:
    return quantile_analysis(df, by, 10, is_series, p_value=False).select(*by, "spread")


def regime_metrics(df, by=(), regime="regime", least=5) -> DataFrame:
    """Metrics per regime with enough rows; share refers to all valid rows."""
    key = [*by, regime]
    v = ranked(df.filter(F.col(regime).isNotNull()), key)
    stats = v.groupBy(*key).agg(
        F.count("*").alias("count"),
        hit_rate_of(F.col("y_true"), F.col("y_pred")).alias("hit_rate"),
        F.avg("y_true").alias("mean_actual"), F.avg("y_pred").alias("mean_pred"),
        F.stddev_pop("y_true").alias("std_actual"),
    )
    stats = stats.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))
    return (
        stats.filter(F.col("count") >= least)
        .join(information_coefficient(v, key).drop("n"), key)
        .join(decile_spread(v, key), key)
    )


def fold_regime_metrics(df, thresholds, column, by=("fold_id",), least=5) -> DataFrame:
    """IC and spread at or below / above the trained threshold of the fold."""
    by = list(by)
    side = F.when(F.col(column) <= F.col("threshold"), "low_vol").otherwise("high_vol")
    key = [*by, "regime"]
    v = ranked(df.join(thresholds, by).withColumn("regime", side), key)
    stats = v.groupBy(*key).agg(F.count("*").alias("_n"))
    enough = F.col("_n") > least
    return (
        stats.join(information_coefficient(v, key).drop("n"), key, "left")
        .join(decile_spread(v, key), key, "left")
        .select(
            *key,
            F.when(enough, F.col("ic")).alias("ic"), F.when(enough, F.col("spread")).alias("spread"),
            F.when(enough, F.col("_n")).otherwise(0).alias("count"),
        )
    )


def tail_metrics(df, by=(), threshold=0.05) -> DataFrame:
    t, p = (finite(F.col(c).cast("double")) for c in ("y_true", "y_pred"))
    au, ad, pu, pd_ = t > threshold, t < -threshold, p > threshold, p < -threshold
    return df.groupBy(*by).agg(
        safe_ratio(count_if(au & pu), count_if(pu)).alias("precision_up"),
        safe_ratio(count_if(ad & pd_), count_if(pd_)).alias("precision_down"),
        safe_ratio(count_if(au & pu), count_if(au)).alias("recall_up"),
        safe_ratio(count_if(ad & pd_), count_if(ad)).alias("recall_down"),
        count_if(au).alias("actual_up"), count_if(ad).alias("actual_down"),
        count_if(pu).alias("pred_up"), count_if(pd_).alias("pred_down"),
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of fold metrics, IC-spread rank correlation."""
    columns = [c for c in ("ic", "spread", "tstat", "monotonicity", "best_sharpe") if c in folds.columns]
    r = with_ranks(folds.withColumn("_all", F.lit(0)), {"i": "ic", "s": "spread"}, ["_all"])
    return r.agg(
        F.count("*").alias("n_folds"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        F.when(F.count("*") > 3, spearman("i", "s")).alias("ic_spread_corr"),
        *[F.avg(c).alias(f"{c}_mean") for c in folds.columns if c.startswith("val_")],
    )


def best_worst_folds(folds: DataFrame, k: int = 3, by: str = "ic", fold: str = "fold_id") -> DataFrame:
    """Top and bottom k folds (two sorted limits, no full sort)."""
    best = folds.orderBy(F.col(by).desc(), fold).limit(k).withColumn("side", F.lit("best"))
    worst = folds.orderBy(F.col(by).asc(), F.col(fold).desc()).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def prediction_diagnostics(df, by=(), threshold=0.03) -> DataFrame:
    """One row per statistic: actual against predicted."""
    def stats(c: str) -> list[tuple[str, Column]]:
        v = finite(F.col(c).cast("double"))
        return [
            ("mean", F.avg(v)), ("std", F.stddev_pop(v)), ("min", F.min(v)), ("max", F.max(v)),
            ("pct_positive", 100.0 * share(v > 0)),
            ("pct_big_up", 100.0 * share(v > threshold)), ("pct_big_down", 100.0 * share(v < -threshold)),
        ]

    t, p = stats("y_true"), stats("y_pred")
    g = df.groupBy(*by).agg(
        *[e.alias(f"_t_{n}") for n, e in t], *[e.alias(f"_p_{n}") for n, e in p]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("statistic"), F.col(f"_t_{n}").alias("actual"), F.col(f"_p_{n}").alias("predicted"))
            for n, _ in t
        ]
    )
    return g.select(*by, F.inline(rows))


def metrics_by_year(df, date="date") -> DataFrame:
    d = df.withColumn("year", F.year(date))
    return point_metrics(d, ["year"]).join(information_coefficient(d, ["year"]).drop("n"), "year")


def evaluate_classifier(df, by=(), label="label", pred="pred", prob="prob", is_series=False, ratio=safe_ratio) -> DataFrame:
    """Precision, recall, F1, AUC by rank sum, confusion counts.

    `ratio` says what a share of nothing is: 0, or NaN with `float_ratio`; without a positive row the
    rank sum and so the AUC is then missing.
    """
    t, p = F.col(label) == 1, F.col(pred) == 1
    by = list(by)
    r = df if by else df.withColumn("_all", F.lit(0))
    r = with_rank(r, prob, by or ["_all"], "s", is_series=is_series)
    pos, neg = count_if(t), count_if(~t)
    area = ratio(F.sum(F.when(t, average_rank("s"))) - pos * (pos + 1) / 2.0, pos * neg)
    c = r.groupBy(*by).agg(
        count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"),
        count_if(~t & ~p).alias("tn"), count_if(t & ~p).alias("fn"),
        area.alias("auc"),
        divide(100.0 * pos, F.count("*")).alias("pct_positive"),
    )
    return c.withColumns(
        {"precision": ratio("tp", F.col("tp") + F.col("fp")),
         "recall": ratio("tp", F.col("tp") + F.col("fn")),
         "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
    )


def bigmove_detection(df, by=(), label="label", pred="pred", ratio=safe_ratio) -> DataFrame:
    """`ratio` says what a share of nothing is: 0, or missing with `divide`."""
    t, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        ratio(count_if(t & p), count_if(p)).alias("precision_bigmove"),
        ratio(count_if(t & p), count_if(t)).alias("recall_bigmove"),
        count_if(p).alias("pred_bigmove"), count_if(t).alias("actual_bigmove"),
    )


def bigmove_strategy(df, by=(), pred="pred", y="y_true", kind="BigMove") -> DataFrame:
    """Trade on predicted big moves.

    `BigMove` has no direction and assumes the right one (an upper bound);
    `BigMoveUp` goes long, `BigMoveDown` short.
    """
    move = {"BigMove": F.abs(y), "BigMoveUp": F.col(y), "BigMoveDown": -F.col(y)}[kind]
    r = F.when(F.col(pred) == 1, move).otherwise(0.0)
    return df.groupBy(*by).agg(
        F.sum(r).alias("total_return"), mean_if(F.col(pred) == 1, r).alias("mean_per_trade"),
        count_if(F.col(pred) == 1).alias("trades"),
    )


def stack_decomposition(df, by=(), base="ridge_pred", resid="resid_pred", lam="lambda") -> DataFrame:
    return df.groupBy(*by).agg(
        corr(base, resid).alias("correlation"), F.var_samp(base).alias("var_ridge"),
        F.var_samp(resid).alias("var_resid"), F.covar_samp(base, resid).alias("cov_rr"),
        F.avg(lam).alias("avg_lambda"),
        divide(F.var_samp(resid), F.var_samp(base)).alias("var_ratio"),
    )


def model_comparison(long: DataFrame, models: Sequence[str], baselines: Sequence[str]) -> DataFrame:
    """Rows `(metric, model, value)` to one row per metric with deltas."""
    wide = long.groupBy("metric").pivot("model", list(models)).agg(F.first("value", ignorenulls=True))
    return wide.withColumns(
        {f"{m}_vs_{b}": F.col(m) - F.col(b) for b in baselines for m in models if m != b}
    )


def baseline_suite(predictions: DataFrame, by=("model",)) -> DataFrame:
    """Several models on one split: one row of metrics each."""
    by = list(by)
    predictions = ranked(predictions, by)
    return (
        point_metrics(predictions, by)
        .join(information_coefficient(predictions, by).drop("n"), by)
        .join(decile_spread(predictions, by), by)
        .join(hit_rate(predictions, by), by)
    )


def clipped_prediction(df, limit: float | None) -> DataFrame:
    return df if limit is None else df.withColumn("y_pred", clip("y_pred", -limit, limit))
