"""Rolling GARCH(1,1) variance with periodic refits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import finite

#: fixed candidate values of the shock and persistence weights
ALPHAS = (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3)
BETAS = (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.94, 0.97)


def _candidates() -> np.ndarray:
    return np.array([(a, b) for a in ALPHAS for b in BETAS if a + b < 0.999])


def variance_path(returns: np.ndarray, refit: int, min_obs: int) -> np.ndarray:
    """Variance at t from returns before t; parameters change every `refit` rows.

    Each refit takes the mean and variance of the history before it, targets
    that variance through omega and picks the candidate weights with the best
    Gaussian likelihood.  All refits and candidates advance together in t.
    """
    x = returns * 100.0
    n = len(x)
    out = np.full(n, np.nan)
    starts = np.arange(min_obs, n, refit)
    if len(starts) == 0:
        return out
    counts = starts.astype(float)
    sums, squares = np.cumsum(x), np.cumsum(x * x)
    mean = sums[starts - 1] / counts
    target = np.maximum(squares[starts - 1] / counts - mean**2, 1e-12)
    grid = _candidates()
    alpha, beta = grid[:, 0][None, :], grid[:, 1][None, :]
    omega = target[:, None] * (1.0 - alpha - beta)
    var = np.repeat(target[:, None], len(grid), axis=1)
    loss = np.zeros_like(var)
    best = np.full(len(starts), -1)
    for t in range(n):
        for_block = np.flatnonzero(starts == t)
        if for_block.size:
            best[for_block] = np.argmin(loss[for_block], axis=1)
        block = (t - min_obs) // refit
        if t >= min_obs:
            out[t] = var[block, best[block]] / 10000.0
        e2 = (x[t] - mean) ** 2
        loss += np.log(var) + e2[:, None] / var
        var = omega + alpha * e2[:, None] + beta * var
    return out


def garch_variance(
    df: DataFrame,
    ret: str = "ret",
    refit: int = 20,
    min_obs: int = 252,
    out: str = "GARCH_Forecast",
    symbol: str = "symbol",
    date: str = "date",
) -> DataFrame:
    """`(symbol, date, variance)`; null before `min_obs` returns.

    Weights come from a fixed grid with variance targeting instead of a free
    likelihood search, so values are close to, not equal to, a full fit.  A
    series is bounded by the calendar, which bounds the group of a task.
    """

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        pdf[out] = variance_path(pdf[ret].to_numpy(float), refit, min_obs)
        return pdf[[symbol, date, out]]

    # a return that is no number is a missing row
    known = df.select(symbol, date, finite(ret).cast("double").alias(ret)).filter(F.col(ret).isNotNull())
    types = dict(df.dtypes)
    fitted = known.groupBy(symbol).applyInPandas(
        one_series, f"{symbol} {types[symbol]}, {date} {types[date]}, {out} double"
    )
    return df.select(symbol, date).join(fitted, [symbol, date], "left")
