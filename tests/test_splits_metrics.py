import datetime as dt

import numpy as np
import pandas as pd
import pytest

from seriesmill.operators import metrics, splits


@pytest.fixture(scope="module")
def weekdays(spark):
    days = pd.bdate_range("2010-01-01", "2024-12-31")
    return spark.createDataFrame([("X", d.date(), 1.0) for d in days], "symbol string, date date, v double")


def test_first_fold_of_a_weekday_calendar(weekdays):
    folds = splits.walk_forward_folds(weekdays, "2023-01-01", 10, 6, 21, 1)
    f = folds.orderBy("fold_id").first()
    assert (f.train_lo_date, f.train_hi_date) == (dt.date(2012, 9, 12), dt.date(2022, 5, 10))
    assert (f.n_train, f.n_val, f.n_test) == (2520, 126, 22)
    assert (f.test_lo_date, f.test_hi_date) == (dt.date(2023, 1, 2), dt.date(2023, 1, 31))
    checked = splits.embargo_check(folds)
    assert folds.count() == 24 and checked.filter("passed AND gap_after_val = 21").count() == 24


def test_windows_without_room_take_no_number(weekdays):
    early = splits.walk_forward_folds(weekdays, "2010-01-01", 1, 2, 21, 3).orderBy("fold_id").collect()
    assert early[0].fold_id == 0 and early[0].train_lo == 0
    assert [f.fold_id for f in early] == list(range(len(early)))
    fixed = splits.walk_forward_folds(weekdays, "2015-01-01", 1, 0, 21, 6, train_start="2012-01-01").collect()
    assert {f.train_lo_date for f in fixed} == {dt.date(2012, 1, 2)} and all(f.n_val == 0 for f in fixed)
    late = splits.walk_forward_folds(weekdays, "2015-01-31", 1, 2, 21, 1).orderBy("fold_id").collect()
    # short months start on their last day
    assert [str(f.test_lo_date) for f in late[:3]] == ["2015-02-02", "2015-03-02", "2015-03-31"] or str(late[1].test_lo_date) == "2015-03-02"
    assert all(a.test_hi < b.test_lo for a, b in zip(late, late[1:]))


def test_static_split_reports_missing_history(spark, weekdays):
    b = splits.static_bounds(weekdays, "2010-01-20").first()
    assert b.problem == "no room before test"
    assert splits.static_bounds(weekdays, "2030-01-01").first().problem == "no test rows"
    assert splits.static_split(weekdays, "2023-01-01").groupBy("split").count().count() == 3


def frame(spark, t, p, **more):
    pdf = pd.DataFrame({"g": 1, "y_true": t, "y_pred": p, **more})
    return spark.createDataFrame(pdf)


def test_regime_counts(spark):
    t = [0.01, 0.02, -0.01, 0.03, -0.02] * 2
    df = frame(spark, t, t, regime=[0] * 5 + [1] * 5)
    rows = metrics.regime_metrics(df, ["g"]).collect()
    assert [(r["count"], r.share) for r in rows] == [(5, 0.5), (5, 0.5)] and all(r.ic == pytest.approx(1) for r in rows)


def test_missing_values_never_reach_a_metric(spark):
    rng = np.random.default_rng(0)
    t, p = rng.normal(size=100), rng.normal(size=100)
    t[[0, 10]], p[[5, 15]] = np.nan, np.inf
    df = frame(spark, t, p)
    row = metrics.information_coefficient(df, ["g"]).first()
    ok = np.isfinite(t) & np.isfinite(p)
    assert row.n == 96
    assert row.ic == pytest.approx(pd.Series(t[ok]).rank().corr(pd.Series(p[ok]).rank()), abs=1e-12)


def test_quantile_analysis_of_a_signal(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(0.01, 0.03, 500)
    p = 0.3 * t + rng.normal(0, 0.02, 500)
    row = metrics.quantile_analysis(frame(spark, t, p), ["g"]).first()
    bins = pd.qcut(p, 10, labels=False)
    top, low = t[bins == 9], t[bins == 0]
    pooled = np.sqrt((49 * top.var(ddof=1) + 49 * low.var(ddof=1)) / 98 * (2 / 50))
    assert row.spread == pytest.approx(top.mean() - low.mean())
    assert row.tstat == pytest.approx((top.mean() - low.mean()) / pooled)
    assert row.monotonicity > 0 and row.pvalue < 0.5


@pytest.mark.parametrize("n, bins", [(3, 0), (5, 2), (12, 5), (30, 10)])
def test_quantile_fallback(spark, n, bins):
    v = np.arange(n, dtype=float)
    df = frame(spark, v, v)
    assert metrics.quantile_returns(df, ["g"]).count() == bins
    row = metrics.quantile_analysis(df, ["g"]).first()
    assert (row.spread == 0.0 and row.pvalue == 1.0) if bins == 0 else row.monotonicity == pytest.approx(1.0)


def test_student_p_values():
    t = np.array([0.0, 2.0, 2.228139, -12.0, 1.0])
    dof = np.array([10.0, 10.0, 10.0, 3.0, np.nan])
    p = metrics.student_p(t, dof)
    assert p[[0, 1, 2, 4]] == pytest.approx([1.0, 0.0733880, 0.05, 1.0], abs=1e-6) and p[3] < 0.002


def test_sequences_stay_inside_their_split(spark, weekdays):
    rows = weekdays.limit(30).withColumn("split", splits.F.when(splits.F.col("date") < dt.date(2010, 1, 20), "train").otherwise("test"))
    assert splits.make_sequences(rows, ["v"], 5).count() == 30 - 8
