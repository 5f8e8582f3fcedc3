import numpy as np
import pandas as pd
import pytest

from seriesmill.functions import prefix


@pytest.mark.parametrize("pieces", [1, 4, 13])
def test_running_equals_cumulative_sums(spark, pieces):
    rng = np.random.default_rng(pieces)
    # one group holds most rows and spans many pieces, others share one
    pdf = pd.DataFrame({"g": np.concatenate([np.full(3000, 7), rng.integers(0, 40, 1500)]), "h": "x"})
    pdf["i"] = rng.permutation(len(pdf))
    pdf["v"] = rng.integers(-9, 9, len(pdf))
    pdf["w"] = pdf["v"].where(pdf["v"] % 3 != 0)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(pdf.drop(columns="w")).selectExpr("*", "CASE WHEN v % 3 <> 0 THEN v END AS w")
        out = prefix.running(df, ["g", "h"], ["i"], {"n": ("count", "v"), "s": ("sum", "w"), "x": ("bit_xor", "v"), "top": ("max", "v")}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    out = out.sort_values(["g", "i"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "i"]).reset_index(drop=True)
    by = want.groupby("g")
    assert (out["n"] == by.cumcount() + 1).all()
    assert (out["s"].fillna(0) == want["w"].fillna(0).groupby(want["g"]).cumsum()).all()
    assert (out["s"].isna() == (want["w"].notna().groupby(want["g"]).cumsum() == 0)).all()
    assert (out["top"] == by["v"].cummax()).all()
    assert (out["x"] == by["v"].transform(lambda v: np.bitwise_xor.accumulate(v.to_numpy()))).all()
    assert list(out.columns) == ["g", "h", "i", "v", "w", "n", "s", "x", "top"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g long, i long, v long")
    assert prefix.running(df, ["g"], ["i"], {"s": ("sum", "v")}).collect() == []
