"""Missing, repeated, late and extreme input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import alignment, checks, linear, metrics, policy, rolling, targets, trees
from seriesmill.sources import store

DAY = dt.date(2020, 1, 1)


def series(spark, values, name="close"):
    return spark.createDataFrame([("A", DAY + dt.timedelta(i), float(v)) for i, v in enumerate(values)], f"symbol string, date date, {name} double")


def test_ridge_of_a_level_feature_and_of_bad_groups(spark):
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(0, 0.01, 2000)
    rows = [("train", 1, float(a), float(2 * (a - 1e6))) for a in x]
    rows += [("train", 2, float("nan"), 1.0), ("train", 2, None, 1.0), ("test", 3, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "split string, fold_id int, f double, y_true double")
    df = df.unionByName(df.filter("fold_id = 1").limit(1).withColumn("f", F.lit(float("nan"))))
    fit = {r.fold_id: r for r in linear.ridge_fit(df, ["f"], alphas=(0.0,)).collect()}
    assert fit[1].coef[0] == pytest.approx(2.0, rel=1e-6)
    assert 2 not in fit or fit[2].coef is None


def test_weights_act_like_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("train", 1, float(a), float(a * 2 + b), int(w)) for a, b, w in zip(rng.normal(size=50), rng.normal(size=50), rng.integers(1, 4, 50))]
    df = spark.createDataFrame(rows, "split string, fold_id int, f double, y_true double, w int")
    weighted = linear.ridge_fit(df, ["f"], weight="w").first()
    repeated = linear.ridge_fit(df.withColumn("k", F.explode(F.sequence(F.lit(1), "w"))), ["f"]).first()
    assert weighted.coef[0] == pytest.approx(repeated.coef[0]) and weighted.intercept == pytest.approx(repeated.intercept)


def test_rolling_values_forget_bad_rows(spark):
    clean = 100 + np.cumsum(np.random.default_rng(3).normal(size=60))
    for bad in (float("nan"), float("inf"), 1e18):
        dirty = clean.copy()
        dirty[20] = bad
        for fn in (lambda d: rolling.dist_from_ma(d, n=5, out="v"), lambda d: rolling.rolling_slope(d, 5, out="v"), lambda d: rolling.ma_slope(d, n=5, step=3, out="v")):
            a = [r.v for r in fn(series(spark, clean)).orderBy("date").collect()]
            b = [r.v for r in fn(series(spark, dirty)).orderBy("date").collect()]
            assert b[:20] == pytest.approx(a[:20], nan_ok=True) if None not in a[:20] else True
            np.testing.assert_allclose(np.array(b[30:], dtype=float), np.array(a[30:], dtype=float), rtol=1e-6)


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan), (0.1, 0.1), (-0.1, 0.2)], "y_true double, y_pred double")
    flags = targets.big_move_labels(df, "y_true").orderBy("y_true").collect()
    assert [r.BigMoveUp for r in flags if r.y_true != r.y_true] == [0]
    assert metrics.tail_metrics(df, (), 0.05).first().pred_up == 2
    for name in policy.POLICIES:
        got = df.select(policy.position("y_pred", name, 0.03, 1.0).alias("p")).collect()[0].p
        assert not got or name == "continuous_sizing" and got is None
    assert {r.statistic: r.predicted for r in metrics.prediction_diagnostics(df).collect()}["max"] == 0.2


def test_trees_keep_incomplete_rows(spark):
    rng = np.random.default_rng(4)
    rows = [("train" if i % 3 else "test", float(a) if i % 10 else None, float(a)) for i, a in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "split string, f double, y_true double").withColumn("side_by", F.col("y_true"))
    out = trees.tree_fit_predict(df, ["f"], maxIter=3)
    assert out.count() == 60 and out.filter("f IS NULL AND y_pred IS NOT NULL").count() == 0 and out.filter("y_pred IS NULL").count() == 6
    assert trees.bigmove_classifier(df.withColumn("label", (F.col("y_true") > 0).cast("int")), ["f"], maxIter=3).count() == 60
    assert trees.regime_gated_hybrid(df, ["f"], "side_by", maxIter=3).count() == 60
    stacked = trees.residual_stack(df.withColumn("split", F.when(F.rand(1) < 0.2, "val").otherwise(F.col("split"))), ["f"], maxIter=3)
    assert stacked.count() == 60 and stacked.select("lambda").distinct().count() == 1


def test_upsert_leaves_one_row_for_a_key(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "x", 7), (1, "y", 6), (2, "late", 8), (3, "n", 1), (3, "n", 1)], "k int, v string, seq int")
    got = {r.k: r.v for r in store.upsert_by_key(old, new, ["k"], "seq").collect()}
    assert got == {1: "x", 2: "b", 3: "n"}
    assert sorted(r.k for r in store.upsert_by_key(old, new, ["k"]).collect()) == [1, 2, 3]


def test_merge_reads_only_touched_months_and_keeps_the_last_arrival(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "symbol string, date date, v double, seq int, month string"
    first = spark.createDataFrame([("A", DAY, 1.0, 9, "2020-01"), ("A", dt.date(2020, 2, 1), 2.0, 3, "2020-02")], schema)
    store.merge_into(spark, path, first, ["symbol", "date"], "month", "seq")
    store.merge_into(spark, path, spark.createDataFrame([("A", DAY, 5.0, 3, "2020-01")], schema), ["symbol", "date"], "month", "seq")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_calendar_align_with_repeated_rows(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(5)], "date date")
    panel = spark.createDataFrame([("A", DAY + dt.timedelta(2), 1.0), ("A", DAY + dt.timedelta(2), 3.0)], "symbol string, date date, close double")
    rows = alignment.calendar_align(panel, days, ["close"]).orderBy("date").collect()
    assert [r.close for r in rows] == [None, None, 3.0, None, None]


def test_known_leaks_are_listed(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(-i)) for i in range(40)], "Target_1M double, noise double, BigMove_x double")
    rows = checks.leakage_correlation(df, ["noise", "BigMove_x"], "Target_1M").collect()
    leaks = checks.known_leaks(["noise", "BigMove_x"], "Target_1M")
    assert [r.feature for r in rows][: len(leaks)] == leaks and all(r.suspicious for r in rows if r.feature in leaks)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), None])
def test_bad_returns_are_missing_returns(spark, bad):
    from seriesmill.operators import garch, rehab

    rng = np.random.default_rng(5)
    values = rng.normal(0, 0.01, 400).tolist()
    rows = [("A", DAY + dt.timedelta(i), v if i != 60 else bad) for i, v in enumerate(values)]
    schema = "symbol string, date date, ret double"
    with_bad, with_null = spark.createDataFrame(rows, schema), spark.createDataFrame([r if i != 60 else (*r[:2], None) for i, r in enumerate(rows)], schema)
    for make in (
        lambda df: garch.garch_variance(df, min_obs=252),
        lambda df: rolling.rv_ratio(df, "ret", out="x"),
        lambda df: rehab.return_zscore(df, 50, ["ret"]),
        lambda df: rehab.zscore126_detrend20(df, "ret", "ret", 50).drop("PCR_Detrend"),
        lambda df: rehab.zscore126_detrend20(df, "ret", "ret", 50),
        lambda df: rolling.rolling_zscore(df, "ret", 50, out="x"),
    ):
        one, two = ([r[-1] for r in make(df).orderBy("date").collect()] for df in (with_bad, with_null))
        assert one == two and sum(v is not None for v in one) > 100
        assert not any(v is not None and v != v for v in one)


@pytest.mark.parametrize("place", [0, 40, 79, 80, 81, 120])
def test_hurst_forgets_a_wild_price(spark, place):
    rng = np.random.default_rng(6)
    values = np.cumsum(rng.normal(0, 1, 500)) + 100
    wild = values.copy()
    wild[place] = 1e9
    plain, hit = ([r.Hurst for r in rolling.rolling_hurst(series(spark, v)).orderBy("date").collect()] for v in (values, wild))
    assert all(v is not None for v in hit[99:])
    # windows that begin after it are those of the clean series
    assert hit[place + 100 :] == pytest.approx(plain[place + 100 :], abs=1e-9)


def test_sums_of_several_lengths(spark):
    from seriesmill.functions.columns import Series, frame_sums

    values = np.random.default_rng(7).normal(size=60)
    df = series(spark, values, "v")
    sums = {f"s{n}": ("v", n) for n in range(7, 15)}
    out = frame_sums(df, Series(), sums, 7).orderBy("date").toPandas()
    for n in range(7, 15):
        want = [values[max(0, i - n + 1) : i + 1].sum() for i in range(60)]
        assert np.allclose(out[f"s{n}"], want, atol=1e-12)
