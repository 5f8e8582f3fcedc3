import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import linear, segments, splits

WF = dict(start="2021-01-01", train_years=1, val_months=2, step_months=1)
X = ["f1", "f2"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    parts = []
    for k, start in enumerate(("2019-01-01", "2019-06-03", "2020-11-02")):
        dates = pd.bdate_range(start, "2022-06-30")
        f = rng.normal(size=(len(dates), 2)) * (1 + k) + 100 * k
        parts.append(pd.DataFrame({"symbol": f"s{k}", "date": dates.date, "f1": f[:, 0], "f2": f[:, 1], "y_true": f @ [0.5, -2.0] + rng.normal(size=len(dates))}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[[5, 400], "f1"] = np.nan
    pdf.loc[[7, 300], "y_true"] = np.inf
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize(("levels", "keys"), [(10, ["fold_id"]), (2, ["fold_id"]), (0, ["fold_id"]), (10, ["symbol", "fold_id"])])
def test_sums_of_folds_equal_those_of_copied_rows(panel, levels, keys):
    folds = splits.walk_forward_folds(panel, **WF)
    got = segments.segment_gram(panel, folds, X, "y_true", keys=keys, levels=levels).toPandas().set_index(keys).sort_index()
    want = linear.gram(splits.fold_rows(panel, folds, splits=("train",)), X, "y_true", keys).toPandas().set_index(keys).sort_index()
    assert (got["_n"].loc[want.index] == want["_n"]).all() and (got["_n"].drop(want.index) == 0).all() and len(want) > 10
    for c in want.columns:
        assert np.allclose(got.loc[want.index, c], want[c], rtol=1e-9, atol=1e-7), c


def test_a_wild_value_outside_a_span_leaves_no_trace(panel):
    folds = splits.walk_forward_folds(panel, **WF).filter("symbol = 's0'")
    wild = panel.withColumn("f1", F.when((F.col("symbol") == "s0") & (F.col("date") == "2019-01-10"), 1e14).otherwise(F.col("f1")))
    key = ["symbol", "fold_id"]
    plain, hit = (segments.walk_forward_fit(p, folds, X, keys=key).toPandas().set_index(key)["coef"] for p in (panel, wild))
    bounds = folds.select(*key, "train_lo_date").toPandas().set_index(key)["train_lo_date"]
    far = [k for k in plain.index if str(bounds[k]) > "2019-01-10"]
    assert len(far) > 10
    for k in far:
        assert np.allclose(plain[k], hit[k], rtol=1e-3), k


@pytest.mark.parametrize("levels", [0, 1, 3, 6])
def test_cover_holds_every_segment_once(spark, levels):
    spans = [(a, b) for a in range(20) for b in range(a, 21)] + [(3, 2)]
    df = spark.createDataFrame(spans, "_from long, _to long").select("_from", "_to", F.expr(segments._cover(levels)).alias("c"))
    for r in df.collect():
        covered = sorted(s for x in r.c for s in range(x._node << x._level, (x._node + 1) << x._level))
        assert covered == list(range(r._from, r._to + 1))
        assert levels < 6 or len(r.c) <= 8


def test_fit_has_no_copied_rows(panel):
    folds = splits.walk_forward_folds(panel, **WF)
    plan = segments.walk_forward_fit(panel, folds, X)._jdf.queryExecution().optimizedPlan().toString()
    assert "position" not in plan and "sequence(train_lo" not in plan


def test_no_rows(spark, panel):
    none = panel.filter("false")
    assert segments.walk_forward_fit(none, splits.walk_forward_folds(none, **WF), X).count() == 0
