"""Steps that took too much disk or memory on large tables: what they sort, copy and rank, and odd values."""

import datetime

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesmill.functions.columns import Series, running_mean
from seriesmill.operators import checks, policy, ranking, rolling, thresholds, trees
from seriesmill.plans import panels

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, n=150, series=2):
    rng = np.random.default_rng(1)
    first = datetime.date(2020, 1, 1)
    rows = [(str(s), first + datetime.timedelta(i), float(x)) for s in range(series) for i, x in enumerate(rng.normal(100, 5, n).cumsum())]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_large_group_named_all(spark):
    df = spark.range(40).select((F.col("id") % 7).cast("double").alias("v"), F.lit(0).alias("_all"))
    far = ranking.with_rank(df, "v", ["_all"], "r", group_rows=5).select("v", "r_below", "r_ties", "r_total")
    near = ranking.with_rank(df, "v", ["_all"], "r").select("v", "r_below", "r_ties", "r_total")
    assert sorted(far.collect()) == sorted(near.collect())


def test_shuffle_ranks_rows_once_and_not_their_copies(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(checks, "with_rank", lambda df, value, by, prefix: ranked.append((value, by)) or ranking.with_rank(df, value, by, prefix))
    df = panel(spark).withColumn("y_true", F.col("close"))
    assert checks.null_model_shuffle(df).first()["passed"] is not None
    assert ranked == [("y_true", ["_all"])]


def test_leakage_with_and_without_nulls(spark):
    df = panel(spark).withColumn("y", F.col("close")).withColumn("same", F.col("close") * 2).withColumn("holes", F.when(F.col("date") > "2020-02-01", -F.col("close")))
    got = {r["feature"]: r for r in checks.leakage_correlation(df, ["same", "holes"], "y").collect()}
    assert got["same"]["correlation"] == pytest.approx(1) and got["holes"]["correlation"] == pytest.approx(-1)
    assert got["same"]["pairs"] == 300 and got["holes"]["pairs"] == 236


def test_mean_needs_one_sort(spark):
    assert plan(running_mean(panel(spark), Series(), [("a", "close", 63), ("b", "close", 50)])).count("Sort [") == 1


def test_hurst_needs_no_window(spark):
    df = rolling.rolling_hurst(panel(spark))
    assert plan(df).count("Window") == 0
    # a wild price is missing and is forgotten with its window
    wild = panel(spark, 300, 1).withColumn("close", F.when(F.col("date") == "2020-01-20", float("inf")).otherwise(F.col("close")))
    got = [r["Hurst"] for r in rolling.rolling_hurst(wild).orderBy("date").collect()]
    assert all(h is None for h in got[:119]) and all(h is not None for h in got[119:])


def test_autocorr_copies_no_rows(spark):
    df = checks.target_autocorr(panel(spark).withColumnRenamed("close", "y_true"))
    assert "Generate" not in plan(df) and "Window" not in plan(df)
    assert df.count() == 50


def test_histogram_groups_by_bin_only(spark):
    df = checks.value_histogram(panel(spark), ["close"])
    assert sum(r["count"] for r in df.collect()) == 300
    assert not any("keys=[column_name" in line and "x#" in line.split("functions=")[0] for line in plan(df).split("\n"))


def forecast(spark, n=150):
    rng = np.random.default_rng(3)
    df = panel(spark, n).drop("close")
    pairs = [(float(t), float(p)) for t, p in zip(rng.normal(0, 0.1, n), rng.normal(0, 0.1, n).round(2))]
    first = datetime.date(2020, 1, 1)
    values = spark.createDataFrame([(first + datetime.timedelta(i), t, p) for i, (t, p) in enumerate(pairs)], "date date, y_true double, y_pred double")
    return df.join(values, "date").withColumn("y_pred", F.when(F.col("date") != "2020-02-01", F.col("y_pred")))


def test_thresholds_copy_no_rows_and_give_what_the_policy_gives(spark):
    df = forecast(spark)
    for tuned in (policy.tune_threshold(df, ["symbol"], "ic_spread"), policy.coverage_performance(df, ["symbol"])[0]):
        assert "Generate" not in plan(tuned) and "Window" not in plan(tuned)
    scored = thresholds.scores(df, ["symbol"], lambda pred: [0.0, 0.1, 0.25, 9.0]).filter("symbol = '1'").collect()
    assert [r["trade_count"] for r in scored][-1] == 0 and scored[-1]["ic"] is None and scored[-1]["spread"] is None
    for row in scored:
        expected = policy.evaluate_policy(df, ["symbol"], "thresholded", threshold=row["threshold"]).filter("symbol = '1'").first()
        for c in thresholds.COUNTS + thresholds.STATS:
            assert row[c] == (None if expected[c] is None else pytest.approx(expected[c], abs=1e-9)), c


def test_threshold_scores_of_odd_rows(spark):
    first = datetime.date(2020, 1, 1)
    rows = [("A", first, None, 0.2), ("A", first + datetime.timedelta(1), 0.5, float("nan")), (None, first, 0.1, 0.1), ("B", first, 0.1, None), ("C", first, float("inf"), -0.3)]
    df = spark.createDataFrame(rows, "symbol string, date date, y_true double, y_pred double")
    got = {r["symbol"]: r for r in policy.tune_threshold(df, ["symbol"], "ic_spread").collect()}
    assert set(got) == {"A", "B", "C"} and got["B"]["best_threshold"] == policy.FALLBACK_GRID[0] and got["B"]["best_score"] is None


def test_tasks_of_a_panel_grow_with_its_lines(spark, monkeypatch):
    few = panels.prices(spark, SF)
    monkeypatch.setattr(panels, "TASK_ROWS", 500)
    many = panels.prices(spark, SF)
    n = -(-panels.table(spark, SF, "lineitem").count() // 500)
    assert n > 4 and many.rdd.getNumPartitions() == n
    assert plan(panels.forecasts(spark, SF)).count("Exchange") == 2
    assert many.exceptAll(few).isEmpty() and few.count() == many.count()


def test_boosted_trees_read_cells_and_equal_those_of_rows(spark):
    rng = np.random.default_rng(5)
    x, z = rng.integers(0, 12, 600), rng.integers(-3, 4, 600)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(x, z, np.sin(x / 3) + 0.1 * z * (x > 7) + rng.normal(0, 0.3, 600))]
    df = spark.createDataFrame(rows, "x double, z int, y_true double")
    _, cells = trees._cells(df, ["x", "z"], "y_true", None)
    assert cells.count() == df.select("x", "z").distinct().count() and cells.agg(F.sum("_w")).first()[0] == 600
    got = trees.predict_tree(trees.fit_tree(df, ["x", "z"], maxIter=4), df, ["x", "z"])
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df)
    plain = GBTRegressor(featuresCol="v", labelCol="y_true", seed=trees.SEED, maxIter=4, stepSize=0.1, maxDepth=4).fit(vectors).transform(vectors)
    expected = {(r["x"], r["z"]): r["prediction"] for r in plain.collect()}
    assert all(r["y_pred"] == pytest.approx(expected[r["x"], r["z"]], abs=1e-12) for r in got.collect())
