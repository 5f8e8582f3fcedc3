"""Rolling trend, volatility, breadth, cross-asset and macro features.

Every function adds columns to a panel.  All of them use the window of one
`Series`, so a chain of features shares a single exchange and sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import (
    Series, clip, divide, finite, running_mean, running_moments, window_sums,
)

SERIES = Series()


def dist_from_ma(df, price="close", n=200, out="Dist_from_200MA", series=SERIES) -> DataFrame:
    df = running_mean(df, series, [("_ma", price, n)])
    return df.withColumn(out, divide(price, "_ma") - 1).drop("_ma")


def ma_slope(df, price="close", n=200, step=20, out="Trend_200MA_Slope", series=SERIES) -> DataFrame:
    df = running_mean(df, series, [("_ma", price, n)])
    return df.withColumn(out, series.pct("_ma", step)).drop("_ma")


def trend_efficiency(df, price="close", n=21, out="Trend_Efficiency", series=SERIES) -> DataFrame:
    """Net move over n rows relative to the path walked, in [0, 1]."""
    df = df.withColumn("_step", F.abs(series.change(price, 1)))
    ratio = divide(F.abs(series.change(price, n)), series.rolling(F.sum, "_step", n))
    return df.withColumn(out, clip(ratio, 0.0, 1.0)).drop("_step")


def trailing_return(df, n, price="close", out=None, *, pad=False, series=SERIES) -> DataFrame:
    """p / p[-n] - 1; `pad` carries the price forward over gaps first."""
    out = out or f"Return_{n}"
    if not pad:
        return df.withColumn(out, series.pct(price, n))
    df = df.withColumn("_p", series.last_known(price))
    return df.withColumn(out, series.pct("_p", n)).drop("_p")


def rolling_slope(df, n, price="close", out=None, series=SERIES) -> DataFrame:
    """Least-squares slope on 0..n-1 over the last n rows, from sums over blocks.

    Prices are taken relative to the first one of the series.
    """
    base = F.first(finite(price), ignorenulls=True).over(series.so_far)
    df = df.withColumns({"_t": series.position().cast("double"), "_y": finite(price) - base})
    df = window_sums(df, series, {"_sy": "_y", "_sty": "_t * _y", "_n": "CASE WHEN _y IS NOT NULL THEN 1D END"}, n)
    middle = F.col("_t") - (n - 1) / 2.0
    slope = (F.col("_sty") - middle * F.col("_sy")) / (n * (n * n - 1) / 12.0)
    return df.withColumn(out or f"Slope_{n}", F.when(F.col("_n") == n, slope)).drop("_t", "_y", "_sy", "_sty", "_n")


#: windows that are laid out at a time
HURST_ROWS = 4096


def hurst_windows(p: np.ndarray, n: int, max_lag: int) -> np.ndarray:
    """Hurst exponent of the last n prices at every row; NaN where one is missing or a difference is constant."""
    lags = range(2, min(n // 2, max_lag))
    log_k = np.log(np.array(lags, dtype=float))
    weights = (log_k - log_k.mean()) / ((log_k - log_k.mean()) ** 2).sum()
    out = np.full(len(p), np.nan)
    for first in range(n - 1, len(p), HURST_ROWS):
        part = p[first - n + 1:first + HURST_ROWS]
        slope = 0.0
        for k, weight in zip(lags, weights):
            d = np.lib.stride_tricks.sliding_window_view(part[k:] - part[:-k], n - k)
            var, square = d.var(axis=1), (d * d).mean(axis=1)
            # rounding noise of a constant difference is not a variance
            slope = slope + weight * np.log(np.where(var > square * 1e-12, var, np.nan))
        out[first:first + HURST_ROWS] = np.clip(slope / 2.0, 0.0, 1.0)
    return out


def rolling_hurst(df, price="close", n=100, max_lag=20, out="Hurst", series=SERIES) -> DataFrame:
    """Half the slope of ln(variance of k-row differences) on ln(k), in [0, 1].

    A window holds n prices, hence n - k differences of lag k.  A task takes one series at a time, which
    the calendar bounds, and `HURST_ROWS` windows of it; a wild price is forgotten with its window.
    """
    order = [(c, "ascending") for c in series.order]
    df = df.drop(out)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        p = np.array(rows[price].cast(pa.float64()).to_numpy(), dtype=float)
        p[~np.isfinite(p)] = np.nan
        h = hurst_windows(p, n, max_lag)
        return rows.append_column(out, pa.array(h, pa.float64(), mask=np.isnan(h)))

    return df.groupBy(*series.by).applyInArrow(add, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def rolling_apply(
    df: DataFrame, column: str, n: int, fn: Callable[[Column], Column], out: str, series=SERIES
) -> DataFrame:
    """User function of the array of the last n values, on full windows only."""
    window = F.collect_list(column).over(series.frame(n))
    df = df.withColumn("_window", window)
    return df.withColumn(out, F.when(F.size("_window") == n, fn(F.col("_window")))).drop("_window")


def python_window(fn: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    """Wrap a NumPy function of one window for `rolling_apply` (Arrow batches)."""

    @F.pandas_udf("double")
    def apply(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None else float(fn(np.asarray(w))))

    return apply


def rv_ratio(df, ret, short=5, long=20, out="RV_Ratio", series=SERIES) -> DataFrame:
    return df.withColumn(out, divide(series.std(ret, short), series.std(ret, long)))


def volume_roc(df, volume="volume", n=5, out="Vol_ROC", series=SERIES) -> DataFrame:
    return df.withColumn(out, series.pct(volume, n))


def breadth_above_sma(
    panel: DataFrame, price="close", n=50, *, available_only=False, out="breadth",
    symbol="symbol", date="date", series=SERIES,
) -> DataFrame:
    """Percent of series above their own n-row mean, per date.

    By default the denominator is the number of series, warming up or not;
    `available_only` counts those with a mean on that date.
    """
    df = running_mean(panel, series, [("_ma", price, n)])
    counted = df.groupBy(date).agg(
        F.count(F.when(F.col(price) > F.col("_ma"), 1)).alias("_above"),
        F.count("_ma").alias("_warm"),
    )
    total = F.col("_warm") if available_only else panel.select(F.count_distinct(symbol)).scalar()
    return counted.select(date, (100.0 * divide(F.col("_above"), total)).alias(out))


def price_ratio(df, a, b, out="HY_Spread") -> DataFrame:
    return df.withColumn(out, divide(a, b))


def sma_diff(df, price, n=50, out="USD_Trend", series=SERIES) -> DataFrame:
    df = running_mean(df, series, [("_ma", price, n)])
    return df.withColumn(out, series.change("_ma", 1)).drop("_ma")


def sma_deviation(df, price, n=50, out="Oil_Deviation", series=SERIES) -> DataFrame:
    df = running_mean(df, series, [("_ma", price, n)])
    return df.withColumn(out, divide(F.col(price) - F.col("_ma"), "_ma")).drop("_ma")


def level_diff(df, level, n=63, out="Yield_Curve", series=SERIES) -> DataFrame:
    return df.withColumn(out, series.change(level, n))


def macro_ffill(df, column, out="ISM_PMI", series=SERIES) -> DataFrame:
    return df.withColumn(out, series.last_known(column))


def rolling_zscore(df, column, n=252, min_periods=None, out="UMich_Sentiment", series=SERIES) -> DataFrame:
    """(x - mean) / std with half the window as minimum."""
    df = running_moments(df, series, [("_mean", "_std", column, n, min_periods or n // 2)])
    return df.withColumn(out, divide(finite(column) - F.col("_mean"), "_std")).drop("_mean", "_std")


def implied_realized_gap(df, implied, ret, n=20, out="Imp_Real_Gap", series=SERIES) -> DataFrame:
    return df.withColumn(out, F.col(implied) / 100.0 - series.std(ret, n) * math.sqrt(252))


def daily_return(df, price="close", out="ret", series=SERIES) -> DataFrame:
    return df.withColumn(out, series.pct(price, 1))


def feature_table(
    panel: DataFrame,
    market: DataFrame,
    *,
    horizon: int = 21,
    start: str | None = None,
    breadth: DataFrame | None = None,
    qc: tuple[str, ...] = (),
    garch: bool = False,
    series: Series = SERIES,
) -> DataFrame:
    """All features, quality flags, price and targets of a panel.

    `panel` holds symbol, date, close, volume; `market` one wide row per date
    (hyg, shy, dxy, oil, t10y2y, pmi, umich, cpc, vix and QC flags).  The
    market is a dated table: it joins on date after its own windows ran once.
    """
    m = price_ratio(market, "hyg", "shy")
    m = running_mean(m, series, [("_dxy", "dxy", 50), ("_oil", "oil", 50)])
    m = m.withColumns(
        {
            "USD_Trend": series.change("_dxy", 1),
            "Oil_Deviation": divide(F.col("oil") - F.col("_oil"), "_oil"),
        }
    )
    m = level_diff(m, "t10y2y")
    m = macro_ffill(m, "pmi")
    m = rolling_zscore(m, "umich")
    market_columns = ["HY_Spread", "USD_Trend", "Oil_Deviation", "Yield_Curve", "ISM_PMI",
                      "UMich_Sentiment", *qc]
    m = m.select("date", *market_columns, F.col("cpc").alias("Put_Call_Ratio"), "vix")

    df = daily_return(panel, series=series)
    df = running_mean(df, series, [("_ma200", "close", 200)])
    df = df.withColumns(
        {
            "MA_Dist_200": divide(F.col("close") - F.col("_ma200"), "_ma200"),
            "Dist_from_200MA": divide("close", "_ma200") - 1,
            "Trend_200MA_Slope": series.pct("_ma200", 20),
            "Return_1M": series.pct("close", 21),
            "Return_3M": series.pct("close", 63),
            "Return_6M": series.pct("close", 126),
            "Return_12M": series.pct("close", 252),
            "RV_Ratio": divide(series.std("ret", 5), series.std("ret", 20)),
            "Vol_ROC": series.pct("volume", 5),
            "_rv": series.std("ret", 20) * math.sqrt(252),
            "Target_1M": divide(series.lead("close", horizon) - F.col("close"), "close"),
            "Log_Target_1M": F.ln(divide(series.lead("close", horizon), "close")),
        }
    )
    df = trend_efficiency(df, series=series)
    df = rolling_slope(rolling_slope(df, 50, series=series), 100, series=series)
    df = rolling_hurst(df, series=series).drop("_ma200")
    df = df.join(m, "date", "left").withColumn("Imp_Real_Gap", F.col("vix") / 100.0 - F.col("_rv"))
    if breadth is not None:
        df = df.join(breadth.withColumnRenamed("breadth", "Sectors_Above_50MA"), "date", "left")
    if garch:
        from seriesmill.operators.garch import garch_variance

        df = df.join(garch_variance(df.select("symbol", "date", "ret")), ["symbol", "date"], "left")
    df = df.drop("_rv", "vix", "ret", "volume").withColumnRenamed("close", "Price")
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    return df.filter(F.col("Target_1M").isNotNull())
