"""Daily backtest scenarios and risk reports of dated return series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, corr, count_if, divide, mean_if, share
from seriesmill.operators.policy import drawdown, equity_curve, position, vol_scalar

HORIZON = 21
BIG_MOVE = 0.03
SCENARIOS = ("ls_daily", "long_only_daily", "ls_monthly", "big_move_daily")


def signal(pred, strategy: str, threshold=BIG_MOVE):
    policy = {"long_short": "long_short", "long_only": "long_flat", "big_move": "thresholded"}[strategy]
    return position(pred, policy, threshold)


def scenario_daily(df, by, strategy="long_short", horizon=HORIZON, threshold=BIG_MOVE, out="position") -> DataFrame:
    """Mean of the last `horizon` signals, traded one row later."""
    s = Series(by)
    df = df.withColumn("_sig", signal("y_pred", strategy, threshold))
    df = df.withColumn("_sig", s.mean("_sig", horizon))
    return df.withColumn(out, F.coalesce(s.lag("_sig", 1), F.lit(0.0))).drop("_sig")


def scenario_monthly(df, by, strategy="long_short", horizon=HORIZON, threshold=BIG_MOVE, out="position") -> DataFrame:
    """Signal of every `horizon`-th row, held until the next, one row later."""
    s = Series(by)
    taken = F.when((s.position() - 1) % horizon == 0, signal("y_pred", strategy, threshold))
    df = df.withColumn("_sig", taken)
    df = df.withColumn("_sig", s.last_known("_sig"))
    return df.withColumn(out, F.coalesce(s.lag("_sig", 1), F.lit(0.0))).drop("_sig")


def scenario_pnl(df, by, ret="ret", cost_bps=5.0, out="pnl") -> DataFrame:
    """position * return less turnover cost; the first turnover is free."""
    turnover = F.coalesce(F.abs(Series(by).change("position", 1)), F.lit(0.0))
    return df.withColumn(out, F.col("position") * F.col(ret) - turnover * (cost_bps / 10000.0))


def underwater(df, by) -> DataFrame:
    """Add `streak`: rows since the last peak (0 at a peak)."""
    s = Series(by)
    df = df.withColumn("_i", s.position())
    last_peak = F.max(F.when(F.col("drawdown") >= 0, F.col("_i"))).over(s.so_far)
    return df.withColumn("streak", F.col("_i") - F.coalesce(last_peak, F.lit(0))).drop("_i")


def risk_metrics(df: DataFrame, by: Sequence[str], r: str = "pnl", periods: int = 252) -> DataFrame:
    """Return, risk, drawdown and trade statistics of a daily return series."""
    by = list(by)
    curve = underwater(drawdown(equity_curve(df, by, r), by), by)
    v = F.col(r)
    wins, losses = F.sum(F.when(v > 0, v)), F.sum(F.when(v < 0, v))
    m = curve.groupBy(*by).agg(
        (F.max_by("equity", "date") - 1).alias("total_return"),
        (F.avg(v) * periods).alias("ann_return"),
        (F.stddev_samp(v) * math.sqrt(periods)).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("streak").alias("dd_duration"),
        share(v > 0).alias("win_rate"),
        F.coalesce(F.abs(divide(wins, losses)), F.lit(0.0)).alias("profit_factor"),
        (F.sqrt(mean_if(v < 0, v * v)) * math.sqrt(periods)).alias("_down"),
        F.max_by("equity", "date").alias("_last"),
        F.count("*").alias("_n"),
    )
    cagr = F.when(F.col("_last") > 0, F.pow("_last", periods / F.col("_n")) - 1)
    return m.withColumn("cagr", cagr).select(
        *by, "total_return", "ann_return", "cagr", "volatility",
        F.coalesce(divide("ann_return", "volatility"), F.lit(0.0)).alias("sharpe"),
        divide("ann_return", "_down").alias("sortino"),
        F.coalesce(divide("ann_return", F.abs("max_drawdown")), F.lit(0.0)).alias("calmar"),
        "max_drawdown", "dd_duration", "win_rate", "profit_factor",
    )


def sortino(df, by, r="pnl", periods=252) -> DataFrame:
    """Works for groups of any size; null without a losing period."""
    v = F.col(r)
    down = F.sqrt(mean_if(v < 0, v * v)) * math.sqrt(periods)
    return df.groupBy(*by).agg(divide(F.avg(v) * periods, down).alias("sortino"))


def calmar(df, by, r="pnl", periods=252) -> DataFrame:
    return risk_metrics(df, by, r, periods).select(*by, "calmar")


def drawdown_duration(df, by, r="pnl") -> DataFrame:
    curve = underwater(drawdown(equity_curve(df, by, r), by), by)
    return curve.groupBy(*by).agg(F.max("streak").alias("dd_duration"))


def scenarios(df, by, ret="ret", threshold=BIG_MOVE, cost_bps=5.0) -> DataFrame:
    """Buy and hold plus the four scenarios as rows `(by, date, scenario, pnl)`.

    All positions are windows of the same series; rows are multiplied last.
    """
    by = list(by)
    df = scenario_daily(df, by, "long_short", out="ls_daily")
    df = scenario_daily(df, by, "long_only", out="long_only_daily")
    df = scenario_monthly(df, by, "long_short", out="ls_monthly")
    df = scenario_daily(df, by, "big_move", threshold=threshold, out="big_move_daily")
    s = Series(by)
    cells = {
        n: F.col(n) * F.col(ret)
        - F.coalesce(F.abs(s.change(n, 1)), F.lit(0.0)) * (cost_bps / 10000.0)
        for n in SCENARIOS
    }
    df = df.select(*by, "date", F.col(ret).alias("buy_and_hold"), *[c.alias(n) for n, c in cells.items()])
    return df.unpivot([*by, "date"], ["buy_and_hold", *SCENARIOS], "scenario", "pnl")


def scenario_report(df, by, ret="ret", threshold=BIG_MOVE) -> DataFrame:
    return risk_metrics(scenarios(df, by, ret, threshold), [*by, "scenario"])


def extended_risk(df: DataFrame, by: Sequence[str], r="pnl", benchmark="ret") -> DataFrame:
    """Beta, capture, best / worst month, shape and tail of a return series."""
    by = list(by)
    v, b = F.col(r), F.col(benchmark)
    tail = F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*by))
    daily = df.withColumn("_var", tail)
    trade = v != 0
    m = daily.groupBy(*by).agg(
        F.regr_slope(v, b).alias("beta"), corr(v, b).alias("correlation"),
        divide(mean_if(b > 0, v), mean_if(b > 0, b)).alias("up_capture"),
        divide(mean_if(b < 0, v), mean_if(b < 0, b)).alias("down_capture"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
        F.max("_var").alias("var_95"), mean_if(v <= F.col("_var"), v).alias("cvar_95"),
        mean_if(trade, v).alias("avg_trade"), count_if(trade).alias("trades"),
    )
    s = Series([*by, "_m"])
    curve = df.withColumn("_m", F.trunc("date", "month")).withColumn("_e", s.compound(r))
    months = curve.groupBy(*by, "_m").agg((F.max_by("_e", "date") - 1).alias("_r"))
    return m.join(months.groupBy(*by).agg(F.max("_r").alias("best_month"), F.min("_r").alias("worst_month")), by)


def rolling_sharpe(df, by, r="pnl", n=63, ann=252, out="rolling_sharpe") -> DataFrame:
    s = Series(by)
    return df.withColumn(out, divide(s.mean(r, n), s.std(r, n)) * math.sqrt(ann))


def ensemble_overlay(df, by, pred="y_pred", ret="ret") -> DataFrame:
    """Sign strategy raw and volatility-targeted next to buy and hold."""
    by = list(by)
    df = vol_scalar(ret, by, lookback=63, min_periods=21, clip_first=True)(df)
    raw = F.signum(pred) * F.col(ret)
    df = df.select(
        *by, "date", raw.alias("raw"), (raw * F.col("vol_scalar")).alias("vol_target"),
        F.col(ret).alias("buy_and_hold"))
    rows = df.unpivot([*by, "date"], ["raw", "vol_target", "buy_and_hold"], "strategy", "pnl")
    return risk_metrics(rows, [*by, "strategy"]).select(
        *by, "strategy", "sharpe", "total_return", "max_drawdown")
