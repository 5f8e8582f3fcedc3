import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import backtest, linear, policy, splits, trees

START = dt.date(2020, 1, 1)


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"symbol": "A", "date": [START + dt.timedelta(days=i) for i in range(n)], **columns})
    return spark.createDataFrame(pdf)


def values(df, name):
    return df.orderBy("date").toPandas()[name].to_numpy(float)


def test_equity_with_losses_beyond_everything(spark):
    r = np.array([0.1, -1.5, 0.2, -2.5, 0.3, -1.0, 0.4])
    got = values(policy.equity_curve(series(spark, r=r), ["symbol"], "r"), "equity")
    np.testing.assert_allclose(got, np.cumprod(1 + r), atol=1e-12)


def test_drawdown_peak_starts_at_first_equity(spark):
    r = np.array([-0.5, 0.1, -0.2, 0.5])
    e = np.cumprod(1 + r)
    peak = np.maximum.accumulate(e)
    got = policy.max_drawdown(series(spark, r=r), ["symbol"], "r").first().max_drawdown
    assert got == pytest.approx(((e - peak) / peak).min())


def test_policy_statistics(spark):
    rng = np.random.default_rng(4)
    t, p = rng.normal(0, 0.02, 200), rng.normal(0, 0.03, 200)
    row = policy.evaluate_policy(series(spark, y_true=t, y_pred=p), ["symbol"], "thresholded", threshold=0.03, cost=0.001).first()
    pos = np.where(p > 0.03, 1.0, np.where(p < -0.03, -1.0, 0.0))
    r = pos * t - np.abs(np.diff(pos, prepend=0)) * 0.001
    act = pos != 0
    assert row.trade_count == act.sum()
    assert row.total_return == pytest.approx(np.prod(1 + r) - 1)
    assert row.sharpe == pytest.approx(r[act].mean() / r[act].std() * np.sqrt(252))
    assert row.hit_rate == pytest.approx((np.sign(pos[act]) == np.sign(t[act])).mean())
    none = policy.evaluate_policy(series(spark, y_true=t, y_pred=p * 0), ["symbol"]).first()
    assert none.trade_count == 0 and none.sharpe is None and none.ic is None and none.total_return == 0


def test_monthly_entry_is_the_next_row(spark):
    n = 70
    y = np.arange(n, dtype=float)
    got = policy.monthly_signals(series(spark, y_true=y, y_pred=y), ["symbol"]).orderBy("date").collect()
    assert [(r.date.day, r.y_pred, r.y_true) for r in got] == [(31, 28.0, 31.0), (29, 57.0, 60.0), (10, 67.0, 0.0)]


def test_first_best_wins_ties_and_rare_trades_are_out(spark):
    p = np.array([0.02] * 20 + [0.5])
    t = np.array([0.01, -0.005] * 10 + [0.9])
    df = series(spark, y_true=t, y_pred=p)
    grid = df.select("symbol").distinct().withColumn("grid", F.array(F.lit(0.005), F.lit(0.01), F.lit(0.1)))
    row = policy.tune_threshold(df, ["symbol"], grid=grid).first()
    assert row.best_threshold == 0.005 and row.tried == 3


def test_drawdown_streak_and_risk(spark):
    r = np.array([0.1, -0.05, -0.05, 0.01, 0.2, -0.01, 0.3])
    row = backtest.risk_metrics(series(spark, pnl=r), ["symbol"]).first()
    assert row.dd_duration == 3 and row.win_rate == pytest.approx(4 / 7)
    assert row.profit_factor == pytest.approx(0.61 / 0.11)
    only_up = backtest.risk_metrics(series(spark, pnl=np.array([0.1, 0.2])), ["symbol"]).first()
    assert only_up.sortino is None and only_up.calmar == 0.0 and only_up.dd_duration == 0


def test_first_turnover_is_free_in_scenarios_only(spark):
    df = series(spark, ret=np.zeros(3), position=np.array([1.0, 1.0, -1.0]))
    assert values(backtest.scenario_pnl(df, ["symbol"]), "pnl") == pytest.approx([0, 0, -0.001])
    df = df.withColumn("y_true", F.lit(0.0))
    assert values(policy.strategy_returns(df, ["symbol"], 0.001), "strategy_return") == pytest.approx([-0.001, 0, -0.002])


@pytest.fixture(scope="module")
def regimes(spark):
    rng = np.random.default_rng(7)
    n = 100
    x, rv = rng.normal(size=n), np.array([0.5, 1.5] * (n // 2))
    y = np.where(rv <= 1, 2, -2) * x + rng.normal(0, 0.1, n)
    return series(spark, x=x, rv=rv, y_true=y).withColumns({"split": F.lit("train"), "fold_id": F.lit(0)})


def test_regime_gated_ridge(regimes):
    assert linear.regime_thresholds(regimes, "rv").first().threshold == 1.0
    out = linear.regime_gated_ridge(regimes, ["x"], "rv").toPandas()
    assert ((out.y_true - out.y_pred) ** 2).mean() < 0.2
    sided = linear.with_side(regimes, "rv")
    coefs = {r.side: r.coef[0] for r in linear.ridge_fit(sided, ["x"], by=["side"]).collect()}
    assert coefs[0] == pytest.approx(2, abs=0.15) and coefs[1] == pytest.approx(-2, abs=0.15)


def test_ridge_of_many_features(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 1, (200, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + 3 + rng.normal(0, 0.1, 200)
    df = series(spark, **{f"x{i}": x[:, i] for i in range(4)}, y_true=y).withColumns({"split": F.lit("train"), "fold_id": F.lit(1)})
    got = linear.ridge_fit(df, [f"x{i}" for i in range(4)], alphas=(0.0, 10.0)).orderBy("alpha").collect()
    c = x - x.mean(0)
    for row in got:
        want = np.linalg.solve(c.T @ c + row.alpha * np.eye(4), c.T @ (y - y.mean()))
        np.testing.assert_allclose(row.coef, want, atol=1e-8)
        assert row.intercept == pytest.approx(y.mean() - want @ x.mean(0))


def test_running_sums_equal_fold_rows(spark):
    rng = np.random.default_rng(9)
    n = 900
    df = series(spark, f=rng.normal(size=n), y_true=rng.normal(size=n))
    folds = splits.walk_forward_folds(df, "2021-06-01", 1, 2, 21, 2)
    fast = linear.solve(linear.walk_forward_gram(df, folds, ["f"], "y_true"), 1, ["symbol", "fold_id"], (1.0,))
    rows = splits.fold_rows(df, folds)
    slow = linear.ridge_fit(rows, ["f"], by=["symbol", "fold_id"])
    a, b = ({r.fold_id: (r.intercept, *r.coef) for r in t.collect()} for t in (fast, slow))
    assert len(a) > 3 and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_trees_and_stack_learn(spark):
    rng = np.random.default_rng(10)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 2 * x + np.where(z > 0, 1.0, -1.0)
    df = series(spark, x=x, z=z, y_true=y).withColumn("split", F.when(F.rand(1) < 0.7, "train").otherwise("test"))
    out = trees.residual_stack(df, ["x", "z"], lam=1.0, maxIter=10).filter("split = 'test'").toPandas()
    ridge = ((out.y_true - out.ridge_pred) ** 2).mean()
    assert ((out.y_true - out.final_pred) ** 2).mean() < 0.5 * ridge
    np.testing.assert_allclose(out.final_pred, out.ridge_pred + out.resid_pred)
    forest = trees.tree_fit_predict(df, ["x", "z"], kind="random_forest", numTrees=10, maxDepth=5).toPandas()
    assert ((forest.y_true - forest.y_pred) ** 2).mean() < 0.5 * y.var()


def test_user_model_per_series(spark):
    df = series(spark, x=np.arange(10.0), y_true=3 * np.arange(10.0)).withColumn("split", F.lit("train"))
    out = linear.grouped_fit_predict(df, lambda x, y: (x * y[:, None]).sum() / (x * x).sum(), lambda m, x: m * x[:, 0], ["x"])
    np.testing.assert_allclose(values(out, "y_pred"), 3 * np.arange(10.0))


def _stepped(spark, n):
    """Rows of 8 x 8 cells."""
    rng = np.random.default_rng(12)
    x, z = rng.integers(0, 8, n) * 1.0, rng.integers(0, 8, n) * 1.0
    y = x + np.where(z > 3, 5.0, 0.0) + rng.normal(size=n)
    return spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist())), "x double, z double, y_true double")


def test_levels_of_a_forest_read_cells(spark, monkeypatch):
    df = _stepped(spark, 6000)
    plain = trees.RandomForestRegressor(featuresCol="_x", labelCol="y_true", numTrees=12, maxDepth=6, seed=3)
    vectors = trees.VectorAssembler(inputCols=["x", "z"], outputCol="_x").transform(df)
    expected = plain.fit(vectors).transform(vectors).toPandas()
    given, fit = [], trees.RandomForestRegressor.fit

    def counted(self, rows, params=None):
        given.append(rows.count())
        return fit(self, rows, params)

    monkeypatch.setattr(trees.RandomForestRegressor, "fit", counted)
    model = trees.fit_tree(df, ["x", "z"], kind="random_forest", numTrees=12, maxDepth=6)
    assert max(given) <= 64
    got = trees.predict_tree(model, df, ["x", "z"]).toPandas()
    error = lambda p: ((p.y_true - p.iloc[:, -1]) ** 2).mean()
    assert abs(error(got) - error(expected)) < 0.05 * error(expected) and error(got) < 1.3
    # a forecast is the mean of its trees, which differ, and does not depend on the run
    forest = model.stages[-1]
    vector = model.stages[1].transform(model.stages[0].transform(df)).first()._x
    each = [t.predict(vector) for t in forest.trees]
    assert len(set(each)) > 1 and forest.predict(vector) == pytest.approx(np.mean(each))
    assert trees.tree_importance(model, ["x", "z"], spark).count() == 2
    again = trees.predict_tree(trees.fit_tree(df, ["x", "z"], kind="random_forest", numTrees=12, maxDepth=6), df, ["x", "z"]).toPandas()
    np.testing.assert_array_equal(np.sort(got.y_pred), np.sort(again.y_pred))


def test_trees_of_a_forest_draw_rows(spark, monkeypatch):
    monkeypatch.setattr(trees, "DRAWN", 100)
    df = _stepped(spark, 4000).withColumn("w", F.lit(2.0))
    binned = trees._binning(df, ["x", "z"])[0][0].transform(df)
    cells = trees._samples(binned, ["_b0", "_b1"], "y_true", "w", 200, 1.0, 5).toPandas()
    truth = binned.toPandas().groupby(["_b0", "_b1"]).y_true.agg(["size", "mean", "var"])
    cells["n"] = cells._w / 2
    cells["s"] = cells.n * cells._y
    by = cells.groupby(["_b0", "_b1"])
    assert len(truth) == 64 and cells.groupby("_tree").size().eq(64).all()
    n, drawn = truth["size"], by.n
    assert (drawn.mean() / n).mean() == pytest.approx(1, abs=0.01)
    assert (drawn.var() / n).mean() == pytest.approx(1, abs=0.1)  # Poisson
    # targets are drawn with their rows: the mean of a cell varies as that of a bootstrap
    assert (by.s.sum() / drawn.sum() - truth["mean"]).abs().max() < 0.05
    assert (by._y.var() / (truth["var"] / n)).mean() == pytest.approx(1, abs=0.15)


def test_a_forest_of_rows_in_cells_of_their_own(spark):
    rng = np.random.default_rng(13)
    rows = [(float(a), float(b), float(a)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y_true double")
    model = trees.fit_tree(df, ["x", "z"], kind="random_forest", numTrees=8, maxDepth=6)
    assert len(model.stages) == 2
    out = trees.predict_tree(model, df, ["x", "z"]).toPandas()
    assert ((out.y_true - out.y_pred) ** 2).mean() < 0.3 * out.y_true.var()
