"""Models of fold rows: rows are kept once, and copies of them are neither written, shuffled nor ranked."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesmill.operators import linear, ranking, splits
from seriesmill.plans import split_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_folds_are_those_of_the_spans(spark):
    first = datetime.date(2020, 1, 1)
    panel = spark.createDataFrame([(s, first + datetime.timedelta(i), float(i)) for s in ("A", "B", None) for i in range(9)], "symbol string, date date, x double")
    spans = [("A", 0, 0, 3, 5, 6), ("A", 1, 2, 5, None, None), ("B", 0, 7, 20, 1, 1), (None, 0, 0, 8, 0, 8), ("C", 0, 0, 8, 0, 8)]
    folds = spark.createDataFrame(spans, "symbol string, fold_id int, train_lo int, train_hi int, val_lo int, val_hi int")
    got = splits.fold_rows(panel, folds, splits=("train", "val"))
    assert got.columns == ["symbol", "position", "date", "x", "fold_id", "split"]
    expected = sorted((s, p, f, name) for s, f, a, b, c, d in spans if s in ("A", "B")
                      for name, lo, hi in (("train", a, b), ("val", c, d)) if lo is not None for p in range(lo, min(hi, 8) + 1))
    assert sorted((r.symbol, r.position, r.fold_id, r.split) for r in got.collect()) == expected
    assert all(r.x == r.position for r in got.collect())
    # positions are not spelled out
    assert "sequence(" not in plan(got)


@pytest.mark.parametrize("rows", [split_queries.tuning_rows, split_queries.walk_rows])
def test_fold_rows_of_models_are_read_from_one_table(spark, rows):
    # each reader of the rows repeats no step before them
    df = rows(spark, SF)
    assert "Exchange" not in plan(df) and "Join" not in plan(df) and plan(df).count("Scan parquet") == 1
    assert df.count() > 0


def _values(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(x)) for i, x in enumerate(rng.normal(size=3000))] + [("ties", float(i % 3)) for i in range(100)]
    rows += [("none", None), (None, 1.0), (None, 4.0), ("wild", float("inf")), ("wild", 2.0), ("zero", -0.0), ("zero", 0.0)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantiles_equal_those_of_ranks(spark, monkeypatch, accuracy):
    df, places = _values(spark), {"low": 0.25, "mid": 0.5, "top": 1.0}

    def by_ranks(df):
        return df.groupBy("k").agg(*[ranking.quantile("v", "g", p).alias(c) for c, p in places.items()]).orderBy("k").collect()

    expected = by_ranks(ranking.with_rank(df, "v", ["k"], "g"))
    wild = df.union(spark.createDataFrame([("a", float("nan"))], df.schema))
    expected_wild = by_ranks(ranking.with_rank(wild, "v", ["k"], "g"))
    ranked = []
    monkeypatch.setattr(ranking, "with_rank", lambda *a, real=ranking.with_rank: ranked.append(a) or real(*a))
    assert repr(ranking.quantiles(df, "v", ["k"], places, accuracy=accuracy).orderBy("k").collect()) == repr(expected)
    assert not ranked
    got = ranking.quantiles(wild, "v", ["k"], places, accuracy=accuracy).orderBy("k").collect()
    assert repr(got) == repr(expected_wild) and len(ranked) == 1


def test_quantiles_outside_of_a_wrong_guess_are_ranked(spark, monkeypatch):
    df = _values(spark)
    real = F.percentile_approx
    # the guess points at the lowest values only
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, shares, accuracy: real(c, [0.0] * len(shares), accuracy))
    got = {r.k: r.m for r in ranking.quantiles(df.filter("k IN ('a', 'ties')"), "v", ["k"], {"m": 0.5}).collect()}
    a = np.array([r.v for r in df.filter("k = 'a'").collect()])
    assert got == {"a": pytest.approx(np.median(a)), "ties": 1.0}


def test_gate_ranks_no_training_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_window_ranks", None)
    monkeypatch.setattr(ranking, "_by_position", None)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"fold_id": np.arange(300) % 3, "split": np.where(np.arange(300) % 5, "train", "test"), "f": rng.normal(size=300), "y_true": rng.normal(size=300)})
    got = {r.fold_id: r.threshold for r in linear.regime_thresholds(spark.createDataFrame(pdf), "f").collect()}
    assert got == {k: pytest.approx(g.f.median()) for k, g in pdf[pdf.split == "train"].groupby("fold_id")}
    # fits are few, and rows are not shuffled to meet them
    out = linear.regime_gated_ridge(spark.createDataFrame(pdf), ["f"], "f")
    assert "hashpartitioning" not in plan(out) and out.count() == 300


@pytest.mark.parametrize("batch", [7, 10_000])
def test_user_models_of_folds_get_each_series_once(spark, batch):
    rng = np.random.default_rng(4)
    first = datetime.date(2020, 1, 1)
    rows = [(s, first + datetime.timedelta(i), *map(float, rng.normal(size=3))) for s, n in (("A", 40), ("B", 25), (None, 30), ("D", 5)) for i in range(n)]
    panel = spark.createDataFrame(rows, "symbol string, date date, f1 double, f2 double, y_true double")
    panel = panel.withColumns({"f1": F.when(F.col("date") != "2020-01-03", F.col("f1")), "y_true": F.when(F.col("date") == "2020-01-04", float("nan")).otherwise(F.col("y_true"))})
    spans = [("A", 0, 0, 9, 12, 14, 16, 20), ("A", 1, 5, 18, 20, 22, 25, 60), ("A", 2, 2, 3, None, None, 8, 9), ("B", 0, 30, 40, 0, 3, 5, 9), ("B", 1, 3, 20, None, None, 21, 24), (None, 0, 0, 9, 10, 11, 12, 13), ("C", 0, 0, 9, 10, 11, 12, 13)]
    folds = spark.createDataFrame(spans, "symbol string, fold_id int, train_lo int, train_hi int, val_lo int, val_hi int, test_lo int, test_hi int")
    models = (lambda x, y: np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]), (lambda m, x: np.column_stack([np.ones(len(x)), x]) @ m)
    by, key = ("symbol", "fold_id"), ["symbol", "fold_id", "split", "date"]
    want = linear.grouped_fit_predict(splits.fold_rows(panel, folds), *models, ["f1", "f2"], by=by)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = linear.grouped_fit_predict(panel, *models, ["f1", "f2"], by=by, folds=folds)
        got = out.orderBy(*key).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = want.orderBy(*key).collect()
    assert out.columns == want.columns and out.dtypes == want.dtypes and plan(out).count("MapInArrow") == 1
    assert len(got) == len(expected) > 70 and any(r.y_pred is None for r in expected)
    for a, b in zip(got, expected):
        assert a[:-1] == b[:-1] and a.y_pred == (None if b.y_pred is None else pytest.approx(b.y_pred, abs=1e-9))


def test_query_of_user_models_copies_no_rows(spark):
    assert "FlatMapGroups" not in plan(entry.queries()["grouped_fit_predict"](spark, SF))
