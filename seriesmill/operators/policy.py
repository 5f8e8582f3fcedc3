"""Trading policies on forecasts of dated series, and their tuning.

`by` names the keys of a series (symbol, or fold and symbol); rows of a series
are ordered by date and bounded by the calendar, so windows are safe.  Thresholds of a
series are scored in NumPy (`thresholds`); other grids of candidates become rows and are
scored in one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import (
    Series, as_col, clip, corr, count_if, divide, finite, mean_if,
)
from seriesmill.operators import thresholds
from seriesmill.operators.metrics import quantile_analysis
from seriesmill.operators.ranking import average_rank, quantile, spearman, with_rank, with_ranks

POLICIES = ("long_flat", "long_short", "thresholded", "continuous_sizing")
#: fixed defaults
TARGET_VOL, VOL_LOOKBACK, MAX_LEVERAGE, MIN_LEVERAGE = 0.15, 21, 2.0, 0.5
FIXED_THRESHOLDS = (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05)
FALLBACK_GRID = (0.01, 0.02, 0.03)
K_GRID = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
CAP_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
COVERAGE_PERCENTILES = (25, 50, 60, 70, 75, 80, 85, 90, 95)
FACTOR = {"daily": 252, "monthly": 12}


def position(pred, policy: str, threshold=0.03, scale=1.0) -> Column:
    """Position of a prediction; `threshold` and `scale` may be columns.

    A prediction that is no number is missing.
    """
    p = finite(as_col(pred).cast("double"))
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if policy == "long_flat":
        return F.when(p > 0, 1.0).otherwise(0.0)
    if policy == "long_short":
        return F.signum(p)
    if policy == "thresholded":
        return F.when(p > t, 1.0).when(p < -t, -1.0).otherwise(0.0)
    if policy == "continuous_sizing":
        s = scale if isinstance(scale, Column) else F.lit(float(scale))
        return clip(divide(p, s), -1.0, 1.0)
    raise ValueError(f"unknown policy {policy}; choose from {POLICIES}")


def sizing_scale(pred, by: Sequence[str], multiple: float = 3.0) -> Column:
    """Scale of continuous sizing: a multiple of the population deviation."""
    std = F.stddev_pop(pred).over(Window.partitionBy(*by))
    return F.when(std > 0, multiple * std).otherwise(1.0)


def vol_scalar(
    ret, by, order=("date",), target=TARGET_VOL, lookback=VOL_LOOKBACK, high=MAX_LEVERAGE,
    low=MIN_LEVERAGE, ann=252, min_periods=None, *, clip_first=False,
) -> DataFrame:
    """Leverage from realised volatility up to the row before (as a function of a frame)."""
    s = Series(by, order)

    def add(df: DataFrame, out: str = "vol_scalar") -> DataFrame:
        vol = s.std(ret, lookback, min_periods or max(1, lookback // 2)) * math.sqrt(ann)
        df = df.withColumn("_v", F.coalesce(vol, F.lit(target)))
        raw = F.when(F.col("_v") == 0, F.lit(high)).otherwise(target / F.nullif("_v", F.lit(0.0)))
        df = df.withColumn("_v", clip(raw, low, high) if clip_first else raw)
        return df.withColumn(out, clip(F.coalesce(s.lag("_v", 1), F.lit(1.0)), low, high)).drop("_v")

    return add


def strategy_returns(df, by, cost=0.0, ret="y_true", out="strategy_return", order=("date",)) -> DataFrame:
    """position * return, less the cost of turnover (the first one counts from 0)."""
    gross = F.col("position") * F.col(ret)
    if cost:
        before = F.lag("position", 1, 0.0).over(Series(by, order).rows)
        gross = gross - F.abs(F.col("position") - before) * cost
    return df.withColumn(out, gross)


def equity_curve(df, by, ret="strategy_return", order=("date",)) -> DataFrame:
    return df.withColumn("equity", Series(by, order).compound(ret))


def drawdown(df, by, order=("date",)) -> DataFrame:
    """Relative distance to the running peak of `equity` (its first value included)."""
    peak = F.max("equity").over(Series(by, order).so_far)
    return df.withColumn("peak", peak).withColumn("drawdown", divide(F.col("equity") - F.col("peak"), "peak"))


def max_drawdown(df, by, ret="strategy_return") -> DataFrame:
    return drawdown(equity_curve(df, by, ret), by).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def sharpe_of(value: Column, ann: float) -> Column:
    """Aggregate: annualised mean / population deviation; 0 without deviation."""
    std = F.stddev_pop(value)
    return F.when(std == 0, 0.0).otherwise(F.avg(value) / F.nullif(std, F.lit(0.0)) * math.sqrt(ann))


def policy_stats(df: DataFrame, by: Sequence[str], ann: float = 252, ranks: bool = True) -> DataFrame:
    """One row per series from `position`, `strategy_return`, `y_true`, `y_pred`.

    Hit, win, IC, spread, average trade and Sharpe look at periods with a
    position only and are null without any.
    """
    by = list(by)
    active = F.col("position") != 0
    r = F.col("strategy_return")
    curve = drawdown(equity_curve(df, by), by)
    if ranks:
        curve = curve.withColumn("_active", active)
        curve = with_ranks(curve, {"t": "y_true", "p": "y_pred"}, [*by, "_active"], is_series=True)
        ic = corr(F.when(active, average_rank("t")), F.when(active, average_rank("p")))
        rank_stats = [F.coalesce(ic, F.lit(0.0)).alias("ic")]
    else:
        rank_stats = []
    hit = F.when(F.signum("position") == F.signum("y_true"), 1.0).otherwise(0.0)
    stats = curve.groupBy(*by).agg(
        F.count("*").alias("n_periods"),
        count_if(active).alias("trade_count"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        (F.avg(r) * ann).alias("ann_return"),
        (F.stddev_pop(r) * math.sqrt(ann)).alias("ann_volatility"),
        sharpe_of(F.when(active, r), ann).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        mean_if(active, hit).alias("hit_rate"),
        mean_if(active, F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        mean_if(active, r).alias("avg_return_per_trade"),
        *rank_stats,
    ).withColumn("holding_frequency", F.col("trade_count") / F.col("n_periods"))
    none = F.col("trade_count") == 0
    stats = stats.withColumn("sharpe", F.when(~none, F.col("sharpe")))
    if ranks:
        spread = quantile_analysis(df.filter(active), by, is_series=True, p_value=False).select(*by, "spread")
        stats = stats.join(spread, by, "left").withColumn("ic", F.when(~none, F.col("ic")))
    return stats


def monthly_signals(df, by, lookback=5) -> DataFrame:
    """Mean of the last rows of each month, dated at its last row.

    `y_true` becomes the forward return of the first row after that date (the
    entry), or 0 if there is none.
    """
    by = list(by)
    s = Series(by)
    df = df.withColumns({"_m": F.trunc("date", "month"), "_next": s.lead("y_true", 1)})
    back = Window.partitionBy(*by, "_m").orderBy(F.col("date").desc())
    df = df.withColumn("_rn", F.row_number().over(back))
    return df.groupBy(*by, "_m").agg(
        F.max("date").alias("date"),
        mean_if(F.col("_rn") <= lookback, "y_pred").alias("y_pred"),
        F.coalesce(F.max(F.when(F.col("_rn") == 1, F.col("_next"))), F.lit(0.0)).alias("y_true"),
    ).drop("_m")


def evaluate_policy(
    df: DataFrame, by: Sequence[str], policy: str = "long_short", *, threshold=0.03, scale=None,
    execution: str = "daily", vol_targeting: bool = False, vol_returns: str = "y_true",
    cost: float = 0.0, ranks: bool = True,
) -> DataFrame:
    """Simulate one policy per series.  Monthly execution trades the mean of
    the last five signals of a month and ignores volatility targeting."""
    by = list(by)
    ann = FACTOR[execution]
    if execution == "monthly":
        df, vol_targeting = monthly_signals(df, by), False
    if policy == "continuous_sizing" and scale is None:
        df = df.withColumn("_scale", sizing_scale("y_pred", by))
        scale = F.col("_scale")
    df = df.withColumn("position", position("y_pred", policy, threshold, 1.0 if scale is None else scale))
    if vol_targeting:
        df = vol_scalar(vol_returns, by, ann=ann)(df).withColumn(
            "position", F.col("position") * F.col("vol_scalar"))
    return policy_stats(strategy_returns(df, by, cost), by, ann, ranks)


def evaluate_all_policies(
    df: DataFrame, by: Sequence[str], *, threshold=0.03, vol_returns: str | None = None, cost=0.0,
    ranks: bool = True,
) -> DataFrame:
    """All policies at once; with `vol_returns` also their `_vt` variants."""
    by = list(by)
    df = df.withColumn("_scale", sizing_scale("y_pred", by))
    variants = [(p, position("y_pred", p, threshold, F.col("_scale"))) for p in POLICIES]
    if vol_returns:
        df = vol_scalar(vol_returns, by)(df)
        variants += [(f"{n}_vt", c * F.col("vol_scalar")) for n, c in variants]
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("position")) for n, c in variants])
    df = df.select(*by, "date", "y_true", "y_pred", F.inline(rows))
    by = [*by, "policy"]
    return policy_stats(strategy_returns(df, by, cost), by, 252, ranks)


# --- tuning -----------------------------------------------------------------


def _candidates(points: int):
    """Percentiles of |forecast| and fixed values up to the 95th, of one series."""
    shares = [(10.0 + i * (80.0 / (points - 1))) / 100.0 for i in range(points)]

    def grid(pred: np.ndarray) -> list[float]:
        x = thresholds.sizes(pred)
        if not len(x):
            return list(FALLBACK_GRID)
        found = np.unique([*thresholds.interpolated(x, shares), *FIXED_THRESHOLDS])
        found = found[found <= thresholds.interpolated(x, [0.95])[0]]
        return list(FALLBACK_GRID) if len(found) < 3 else found.tolist()

    return grid


def _coverage_candidates(pred: np.ndarray) -> list[float]:
    x = thresholds.sizes(pred)
    return np.unique([0.0, *(thresholds.interpolated(x, [p / 100.0 for p in COVERAGE_PERCENTILES]) if len(x) else ())]).tolist()


def threshold_grid(df, by, points: int = 10, pred="y_pred") -> DataFrame:
    """`(by, grid)`: percentiles of |pred| and fixed values up to the 95th."""
    return thresholds.grids(df, by, _candidates(points), pred)


#: scores that agree to this many decimals tie: their last bits depend on the
#: order in which partial sums are combined
TIE_DIGITS = 10


def first_best(score: Column, value: str, out: str | None = None) -> Column:
    """Aggregate: smallest candidate among those with the best score."""
    order = F.struct(F.round(score, TIE_DIGITS), -F.col(value))
    return F.max_by(out or value, F.when(score.isNotNull(), order))


def tune_threshold(df, by, criterion="sharpe", points=10, min_trades=0.1, grid=None) -> DataFrame:
    """Best threshold per series; candidates that trade too rarely are out.

    Without any usable candidate the first one of the grid is kept.
    """
    by = list(by)
    s = thresholds.scores(df, by, _candidates(points) if grid is None else grid, ranks=criterion == "ic_spread")
    measure = {
        "sharpe": F.col("sharpe"), "total_return": F.col("total_return"), "hit_rate": F.col("win_rate"),
        "ic_spread": F.col("ic") * F.col("spread") if criterion == "ic_spread" else None,
    }[criterion]
    score = F.when(F.col("holding_frequency") >= min_trades, measure)
    return s.withColumn("_score", score).groupBy(*by).agg(
        F.coalesce(first_best(F.col("_score"), "threshold"), F.min("threshold")).alias("best_threshold"),
        F.max("_score").alias("best_score"),
        F.count("*").alias("tried"),
    )


def tune_and_evaluate(df, by, split="split", criterion="sharpe", ranks=True) -> DataFrame:
    """Tune on `val` rows only, apply to `val` and `test`; one row per split."""
    by = list(by)
    tuned = tune_threshold(df.filter(F.col(split) == "val"), by, criterion).select(*by, "best_threshold")
    rows = df.filter(F.col(split).isin("val", "test")).join(tuned, by)
    rows = rows.withColumn("position", position("y_pred", "thresholded", F.col("best_threshold")))
    key = [*by, split, "best_threshold"]
    return policy_stats(strategy_returns(rows, key), key, 252, ranks)


def aggregate_tuned(results: DataFrame, split="split") -> DataFrame:
    """Summary of tuned series; test figures skip nulls, validation ones do not."""
    val, test = F.col(split) == "val", F.col(split) == "test"
    r = with_rank(
        results.withColumns({"_all": F.lit(0), "_ts": F.when(test, F.col("sharpe"))}), "_ts", ["_all"], "s")

    def strict(agg, c):
        missing = count_if(val & F.col(c).isNull())
        return F.when(missing == 0, agg(F.when(val, F.col(c))))

    def on_test(agg, c):
        return agg(F.when(test, F.col(c)))

    tau = F.when(test, F.col("best_threshold"))
    return r.agg(
        count_if(test).alias("n_folds"),
        F.avg(tau).alias("threshold_mean"), F.stddev_pop(tau).alias("threshold_std"),
        F.min(tau).alias("threshold_min"), F.max(tau).alias("threshold_max"),
        strict(F.avg, "sharpe").alias("val_sharpe_mean"), strict(F.stddev_pop, "sharpe").alias("val_sharpe_std"),
        on_test(F.avg, "sharpe").alias("test_sharpe_mean"), on_test(F.stddev_pop, "sharpe").alias("test_sharpe_std"),
        quantile("_ts", "s", 0.5).alias("test_sharpe_median"),
        on_test(F.avg, "total_return").alias("test_return_mean"),
        on_test(F.sum, "total_return").alias("test_return_sum"),
        on_test(F.avg, "hit_rate").alias("test_hit_rate_mean"),
        on_test(F.sum, "trade_count").alias("test_trade_count_total"),
    )


def _best_of_grid(df, by, out: str, ret: Column, grid: Sequence[float], execution: str) -> DataFrame:
    ann = FACTOR[execution]
    rows = df.withColumn(out, F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("_r", ret)
    std = F.stddev_pop("_r")
    sharpe = F.when(std > 1e-8, F.avg("_r") / F.nullif(std, F.lit(0.0)) * math.sqrt(ann)).otherwise(0.0)
    scored = rows.groupBy(*by, out).agg(sharpe.alias("_sharpe"))
    return scored.groupBy(*by).agg(
        first_best(F.col("_sharpe"), out).alias(f"best_{out}"), F.max("_sharpe").alias("best_sharpe"))


def tune_k(df, by, z="z", ret="y_true", grid=K_GRID, execution="monthly") -> DataFrame:
    """Multiplier of clip(k * z, -1, 1); works for groups of any size."""
    return _best_of_grid(df, by, "k", clip(F.col("k") * F.col(z), -1.0, 1.0) * F.col(ret), grid, execution)


def tune_regime_cap(df, by, pos="position", regime="regime", ret="y_true", grid=CAP_GRID, execution="monthly") -> DataFrame:
    """Cap on positions of regime 0; works for groups of any size."""
    capped = F.when(F.col(regime) == 0, F.col(pos) * F.col("cap")).otherwise(F.col(pos))
    return _best_of_grid(df, by, "cap", capped * F.col(ret), grid, execution)


# --- coverage ---------------------------------------------------------------


def coverage_performance(df, by) -> tuple[DataFrame, DataFrame]:
    """Thresholded policy at 0 and percentiles of |pred|.

    Returns the curve (one row per series and threshold) and its summary.
    """
    by = list(by)
    # |pred| > t is exactly "holds a position", so the IC of traded rows is `ic`
    curve = thresholds.scores(df, by, _coverage_candidates).select(
        *by, "threshold", F.col("holding_frequency").alias("coverage"), "sharpe", "total_return", "trade_count",
        F.when(F.col("trade_count") > 5, F.col("ic")).otherwise(0.0).alias("ic_when_trading"))
    ok = (F.col("coverage") > 0.05) & F.col("sharpe").isNotNull()
    sharpe = F.when(ok, F.col("sharpe"))
    r = with_ranks(curve, {"c": "coverage", "s": "sharpe"}, by, is_series=True)
    summary = r.groupBy(*by).agg(
        F.coalesce(first_best(sharpe, "threshold"), F.lit(0.0)).alias("best_threshold"),
        F.coalesce(first_best(sharpe, "threshold", "coverage"), F.lit(1.0)).alias("best_coverage"),
        F.coalesce(F.max(sharpe), F.lit(0.0)).alias("best_sharpe"),
        F.when(
            (F.count("*") >= 3) & (F.count("sharpe") == F.count("*")), spearman("c", "s")
        ).otherwise(0.0).alias("coverage_sharpe_corr"),
    )
    return curve, summary


def clipped_strategy(df, by, limit, policy="long_short", threshold=0.03, **options) -> DataFrame:
    return evaluate_policy(
        df.withColumn("y_pred", clip("y_pred", -limit, limit)), by, policy, threshold=threshold, **options)


def pooled_coverage(df: DataFrame, by: Sequence[str], ann: float = 252) -> DataFrame:
    """Best threshold of the thresholded policy over a pooled group of any size.

    Only means are compared (a pool has no equity curve): `best_threshold`,
    `best_coverage`, `best_sharpe` among thresholds that trade over 5% of rows.
    """
    by = list(by)
    a = df.withColumn("_a", F.abs("y_pred"))
    grid = with_rank(a, "_a", by, "a").groupBy(*by).agg(F.array_sort(F.array_distinct(F.array(
        F.lit(0.0), *[quantile("_a", "a", p / 100.0) for p in COVERAGE_PERCENTILES]))).alias("_grid"))
    rows = df.join(grid, by).select(*by, "y_true", "y_pred", F.explode("_grid").alias("threshold"))
    pos = position("y_pred", "thresholded", F.col("threshold"))
    curve = rows.withColumn("_r", F.when(pos != 0, pos * F.col("y_true"))).groupBy(*by, "threshold").agg(
        (F.count("_r") / F.count("*")).alias("coverage"), sharpe_of(F.col("_r"), ann).alias("sharpe"))
    ok = F.when((F.col("coverage") > 0.05), F.col("sharpe"))
    return curve.groupBy(*by).agg(
        F.coalesce(first_best(ok, "threshold"), F.lit(0.0)).alias("best_threshold"),
        F.coalesce(first_best(ok, "threshold", "coverage"), F.lit(1.0)).alias("best_coverage"),
        F.coalesce(F.max(ok), F.lit(0.0)).alias("best_sharpe"))


def pooled_sharpe(df: DataFrame, by: Sequence[str], threshold: float = 0.03, ann: float = 252) -> DataFrame:
    """Sharpe of the sign and the thresholded strategy over a pooled group."""
    def sharpe(policy: str) -> Column:
        pos = position("y_pred", policy, threshold)
        return sharpe_of(F.when(pos != 0, pos * F.col("y_true")), ann)

    return df.groupBy(*by).agg(
        sharpe("long_short").alias("strategy_sharpe"), sharpe("thresholded").alias("big_move_sharpe"))
