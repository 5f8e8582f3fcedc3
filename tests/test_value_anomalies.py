"""Every step of the value check: describe, distinct values, infinities and counts in bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesmill.operators import checks
from tools.check import compare, connect


def test_values_are_described_as_by_pandas(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200)
    x[:5] = np.nan
    few = (np.arange(200) % 3).astype(float)
    df = spark.createDataFrame([(None if v != v else float(v), int(f), 2.5, None) for v, f in zip(x, few)], "x double, few int, same double, none double")
    got = {r["column_name"]: r for r in checks.value_anomalies(df, df.columns).collect()}
    pdf = pd.DataFrame({"x": x, "few": few})
    for c, d in pdf.describe().items():
        r = got[c]
        assert [r["n_values"], r["mean"], r["std"], r["min_value"], r["p25"], r["median"], r["p75"], r["max_value"]] == pytest.approx(d.tolist())
        assert [r[f"bin_{k}"] for k in range(10)] == pdf[c].value_counts(bins=10).sort_index().tolist()
        assert r["distinct_values"] == pdf[c].nunique() and r["few_values"] == (c == "few")
    assert got["same"]["bin_0"] == 200 and got["same"]["median"] == 2.5
    assert got["none"]["n_values"] == 0 and got["none"]["median"] is None and not any(got["none"][f"bin_{k}"] for k in range(10))


def test_infinities_are_counted_and_in_no_bin(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 10.0, inf, inf, -inf)], "x double")
    r = checks.value_anomalies(df, ["x"]).first()
    assert r["infinite"] == 3 and r["n_values"] == 6 and r["max_value"] == inf
    assert [r[f"bin_{k}"] for k in range(10)] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_query_describes_every_feature(spark):
    sf = "/root/testdata/sf0.001"
    df = entry.queries()["value_anomalies"](spark, sf)
    assert compare(df.toPandas(), connect(sf).sql(entry.oracle_sql()["value_anomalies"]).df()) == ""
    assert {r.column_name for r in df.collect()} == {"y_true", "y_pred", "ret", "f1", "f2", "regime"}
    bins = df.select("n_values", sum((F.col(f"bin_{k}") for k in range(10)), F.lit(0)).alias("n")).collect()
    assert all(r.n == r.n_values > 0 for r in bins)
