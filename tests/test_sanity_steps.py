"""The sanity suite goes step by step: one copy of the rows at a time, and files of a step go before the next."""

import datetime
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions import lineage
from seriesmill.operators import checks, ranking, splits


def rows_of(spark, n=90, series=("A", "B", None)):
    rng = np.random.default_rng(9)
    first = datetime.date(2020, 1, 1)
    rows = [(s, first + datetime.timedelta(i), float(y), float(x)) for s in series for i, (y, x) in enumerate(rng.normal(size=(n, 2)).round(1))]
    return rows, spark.createDataFrame(rows, "symbol string, date date, y_true double, x double")


def folder(spark):
    return spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize(("bucket", "task"), [(16_000, 500_000), (5, 20)])
def test_shuffled_pairs_are_those_of_the_two_orders(spark, monkeypatch, bucket, task):
    monkeypatch.setattr(checks, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(checks, "TASK_ROWS", task)
    rows, df = rows_of(spark)
    before = set(os.listdir(folder(spark)))
    got = checks.null_model_shuffle(df, seeds=[0, 3]).first()
    # no table of a step is left
    assert not [f for f in set(os.listdir(folder(spark))) - before if f.startswith("written-")]
    here = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    ics, sharpes = [], []
    for seed in (0, 3):
        there = sorted(rows, key=lambda r: hashlib.md5("|".join([str(seed), *([r[0]] if r[0] else []), str(r[1])]).encode()).digest())
        t, p = np.array([r[2] for r in here]), np.array([r[2] for r in there])
        ics.append(checks.rank_correlation(t, p))
        gain = (np.sign(p) * t)[p != 0]
        sharpes.append(gain.mean() / gain.std() * np.sqrt(252))
    assert [got["ic_mean"], got["ic_std"], got["sharpe_mean"], got["sharpe_std"]] == pytest.approx([np.mean(ics), np.std(ics), np.mean(sharpes), np.std(sharpes)])


def test_shuffle_without_rows_or_deviation(spark):
    _, df = rows_of(spark)
    none = checks.null_model_shuffle(df.withColumn("y_true", F.lit(float("nan")))).first()
    assert none["ic_mean"] is None and none["passed"] is None
    same = checks.null_model_shuffle(df.withColumn("y_true", F.lit(0.1))).first()
    assert same["ic_mean"] == 0 and same["sharpe_mean"] == 0


def test_features_of_many_rows_are_ranked_one_at_a_time(spark, monkeypatch):
    _, df = rows_of(spark)
    df = df.withColumn("holes", F.when(F.col("date") > "2020-01-20", F.col("x"))).withColumn("z", -F.col("y_true"))
    near = checks.leakage_correlation(df, ["x", "holes", "z"], "y_true").collect()
    ranked = []
    monkeypatch.setattr(checks, "GROUP_ROWS", 50)
    monkeypatch.setattr(checks, "with_ranks", lambda d, v, by: ranked.append(d.columns) or ranking.with_ranks(d, v, by, group_rows=50))
    monkeypatch.setattr(checks, "with_rank", lambda d, v, by, p: ranked.append(d.columns) or ranking.with_rank(d, v, by, p, group_rows=50))
    far = checks.leakage_correlation(df, ["x", "holes", "z"], "y_true").collect()
    # the target once for the features without holes
    assert ranked == [["_all", "y", "x0", "x2"], ["_all", "_b", "x"], ["_all", "_b", "x"], ["_all", "y", "x"]]
    assert [(r.feature, r.pairs, r.suspicious) for r in far] == [(r.feature, r.pairs, r.suspicious) for r in near]
    assert [r.correlation for r in far] == pytest.approx([r.correlation for r in near])


def test_suite_leaves_no_files(spark):
    _, df = rows_of(spark, 300, ("A", "B"))
    df = df.withColumns({"y_pred": F.col("x"), "fold_id": F.lit(0)})
    folds = splits.embargo_audit(splits.walk_forward_folds(df, "2020-06-01", 0.2, 1))
    before = set(os.listdir(folder(spark)))
    out = checks.sanity_suite(df, folds, ["x"])
    assert not [f for f in set(os.listdir(folder(spark))) - before if f.startswith("written-")]
    assert [r["check"] for r in out.collect()] == [
        "missing_values", "enough_rows", "embargo_ok", "no_leakage_corr", "autocorr_checked", "constant_pred_ok", "perfect_pred_ok", "shuffled_ic_ok"]
    assert out.columns == ["check", "value", "passed", "critical"]


def test_scratch_keeps_what_outlives_it(spark):
    with lineage.scratch(spark):
        with lineage.scratch(spark):
            gone, kept = lineage.written(spark.range(3)), lineage.outlive(lineage.written(spark.range(4)))
        assert not os.path.exists(gone._written) and kept.count() == 4
    assert not os.path.exists(kept._written)
