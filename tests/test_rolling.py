import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, finite, running_moments
from seriesmill.operators import garch, rehab, rolling, targets


def panel(spark, values, symbol="A", column="close"):
    start = dt.date(2020, 1, 1)
    rows = [(symbol, start + dt.timedelta(days=i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, date date, {column} double")


@pytest.fixture(scope="module")
def walk():
    return 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 400)))


def column(df, name):
    return df.orderBy("date").toPandas()[name].to_numpy(float)


def test_running_mean_and_slope_match_pandas(spark, walk):
    s = pd.Series(walk)
    got = column(rolling.sma_deviation(panel(spark, walk), "close", 50, out="d"), "d")
    want = (s / s.rolling(50).mean() - 1).to_numpy()
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-10)
    got = column(rolling.rolling_slope(panel(spark, walk), 50, out="s"), "s")
    want = s.rolling(50).apply(lambda y: np.polyfit(np.arange(50), y, 1)[0], raw=True).to_numpy()
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-8)


def test_hurst_matches_the_formula(spark, walk):
    def one(w):
        lags = range(2, 20)
        v = [np.var(w[k:] - w[:-k]) for k in lags]
        return np.clip(np.polyfit(np.log(lags), np.log(v), 1)[0] / 2, 0, 1)

    want = pd.Series(walk).rolling(100).apply(one, raw=True).to_numpy()
    np.testing.assert_allclose(column(rolling.rolling_hurst(panel(spark, walk)), "Hurst"), want, rtol=0, atol=1e-8)
    line = column(rolling.rolling_hurst(panel(spark, np.arange(150.0))), "Hurst")
    assert np.isnan(line).all()  # no variance, no exponent


def test_running_moments_gaps_and_constant_windows(spark):
    values = [5.0] * 30 + [np.nan] + list(np.linspace(1e6, 1e6 + 1, 60))
    s = pd.Series(values)
    df = running_moments(panel(spark, values), Series(), [("m", "sd", "close", 20, 10)])
    np.testing.assert_allclose(column(df, "m"), s.rolling(20, min_periods=10).mean(), rtol=1e-12)
    got = column(df, "sd")
    assert np.isnan(got[:9]).all() and (got[9:30] == 0).all()
    exact = [np.nanstd(values[i - 19:i + 1], ddof=1) for i in range(30, len(values))]
    np.testing.assert_allclose(got[30:], exact, rtol=1e-6)


def test_rolling_needs_full_windows(spark):
    df = panel(spark, [1, 2, None, 4, 5, 6])
    got = column(df.withColumn("m", Series().mean("close", 3)), "m")
    assert np.isnan(got[:5]).all() and got[5] == 5.0


def test_zero_and_infinite_values_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.0, None, None, None, None]
    out = rolling.trailing_return(panel(spark, [0.0, 3.0]), 1, out="r")
    assert np.isnan(column(out, "r")).all()


def test_python_window_function(spark, walk):
    fn = rolling.python_window(lambda w: float(np.median(w)))
    got = column(rolling.rolling_apply(panel(spark, walk[:60]), "close", 7, fn, "m"), "m")
    np.testing.assert_allclose(got, pd.Series(walk[:60]).rolling(7).median())


def test_garch_tracks_volatility(spark):
    rng = np.random.default_rng(5)
    scale = np.where(np.arange(700) < 500, 0.005, 0.02)
    out = garch.garch_variance(panel(spark, rng.normal(0, 1, 700) * scale, column="ret"))
    v = column(out, "GARCH_Forecast")
    assert np.isnan(v[:252]).all() and (v[252:] > 0).all()
    assert v[560:].mean() > 4 * v[300:500].mean()


def test_rehab_columns_and_warm_up(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2020-01-01", periods=n).date,
                        **{c: rng.normal(size=n) for c in ("Price", "RV_Ratio", "HY_Spread", "Yield_Curve", "Return_3M", "Return_6M", "Return_12M")}})
    df = spark.createDataFrame(pdf)
    out = rehab.rehab_features(df)
    added, dropped = rehab.changed_columns(df, out)
    assert "HY_Spread_Diff" in added and {"RV_Ratio", "Return_3M", "HY_Spread"} <= set(dropped)
    assert out.count() == n - 251


def test_feature_names_without_leaks(spark):
    names = ["symbol", "date", "RSI_14", "SMA_50", "Target_1M", "Log_Target_1M", "BigMove", "BigMoveUp", "BigMoveDown", "Price"]
    df = spark.createDataFrame([tuple(["a"] * len(names))], names)
    assert targets.feature_columns(df) == ["RSI_14", "SMA_50"]


def test_next_month_end_rule(spark):
    rows = [("A", dt.date(2020, 1, 15), 10.0), ("A", dt.date(2020, 1, 31), 11.0), ("A", dt.date(2020, 2, 28), 22.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {r.date.day: round(r.y, 6) for r in targets.next_month_return_daily(df, out="y").collect()}
    # the 31st is a month end and looks to February; 28 Feb 2020 is not one
    assert got == {15: 0.1, 31: 1.0, 28: 0.0}
    assert df.filter(F.col("close") > 0).count() == 3
