import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from seriesmill.functions import prefix
from seriesmill.operators import metrics, ranking


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"g": "hot", "v": rng.integers(-40, 40, 3000) / 8.0})
    hot.loc[:999, "v"] = 0.0  # one value holds a third of the rows
    small = pd.DataFrame({"g": "small", "v": rng.normal(size=25)})
    pdf = pd.concat([hot, small], ignore_index=True)
    pdf["id"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture
def pieces(spark, request):
    """So many range pieces as asked for."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("pieces", [1, 7, 60], indirect=True)
def test_rank_of_pieces_equals_average_rank(values, pieces):
    pdf, df = values
    out = ranking.with_rank(df, "v", ["g"], "r", group_rows=0).select(
        "id", ranking.average_rank("r").alias("rank"), "r_total").toPandas().set_index("id").sort_index()
    want = pdf.groupby("g")["v"].rank()
    assert np.array_equal(out["rank"].to_numpy(), want.to_numpy())
    assert (out["r_total"].to_numpy() == pdf.groupby("g")["v"].transform("size").to_numpy()).all()


def test_series_rank_equals_chunked_rank_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, None, 1.0, 3.0, 2.0])], "g string, id int, v double")
    cols = ["id", "r_below", "r_ties", "r_total"]
    a = ranking.with_rank(df, "v", ["g"], "r", is_series=True).select(cols).orderBy("id").collect()
    b = ranking.with_rank(df, "v", ["g"], "r", group_rows=0).select(cols).orderBy("id").collect()
    assert a == b
    assert a[1][1] is None and a[0][1:] == (2, 2, 4)


@pytest.mark.parametrize("pieces", [9, 40], indirect=True)
@pytest.mark.parametrize("many", [[0.0], [0.0, 1.0], [float("nan"), 1.0, 2.0]])
def test_few_values_spread_over_all_pieces(spark, pieces, many):
    rng = np.random.default_rng(len(many))
    pdf = pd.DataFrame({"g": [None if i % 3 == 0 else "a" for i in range(2000)], "v": rng.choice(many, 2000)})
    pdf["id"] = range(2000)
    df = spark.createDataFrame([(g, None if i % 7 == 0 else float(v), i) for g, v, i in pdf.itertuples(index=False)], "g string, v double, id long")
    out = ranking.with_rank(df, "v", ["g"], "r", group_rows=0).select("g", "v", "r_below", "r_ties", "r_total", "id").collect()
    groups = {}
    for r in out:
        if r.v is not None:
            groups.setdefault(r.g, []).append(float("inf") if r.v != r.v else r.v)
    assert len(out) == 2000
    for r in out:
        if r.v is None:
            assert r.r_below is None and r.r_ties is None and r.r_total is None
            continue
        own, v = groups[r.g], float("inf") if r.v != r.v else r.v
        assert (r.r_below, r.r_ties, r.r_total) == (sum(x < v for x in own), own.count(v), len(own))
    dealt = prefix.dealt(df.withColumn("_row", F.monotonically_increasing_id()), ["g"], ["v", "_row"]).groupBy(prefix.PIECE).count().collect()
    assert max(r["count"] for r in dealt) < 2000 / pieces * 4


def test_groups_of_counted_size_are_ranked_alike(values):
    _, df = values
    columns = ["id", "r_below", "r_ties", "r_total"]
    few, many = (sorted(ranking.with_rank(df, "v", ["g"], "r", group_rows=n).select(columns).collect()) for n in (10**6, 100))
    assert few == many


@pytest.mark.parametrize("pieces", [5], indirect=True)
def test_ranks_without_groups_and_without_rows(spark, pieces):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)], "v double")
    assert {(r.v, r.r_below, r.r_ties, r.r_total) for r in ranking.with_rank(df, "v", [], "r", group_rows=0).collect()} == {(float(i), 20 * i, 20, 100) for i in range(5)}
    assert ranking.with_rank(df.filter("false"), "v", [], "r", group_rows=-1).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantile_interpolates_like_numpy(values, p):
    pdf, df = values
    out = ranking.with_rank(df, "v", ["g"], "r", group_rows=0).groupBy("g").agg(ranking.quantile("v", "r", p).alias("q"))
    got = dict(out.collect())
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)


@pytest.mark.parametrize("bins", [2, 5, 10])
def test_bins_equal_quantile_cut(values, bins):
    pdf, df = values
    out = ranking.with_rank(df, "v", ["g"], "r", group_rows=0).select("id", "g", ranking.quantile_bin("r", bins).alias("b")).toPandas()
    out = out.set_index("id").sort_index()
    for g, part in pdf.groupby("g"):
        want = pd.qcut(part["v"], bins, labels=False, duplicates="drop")
        got = out.loc[part.index, "b"].rank(method="dense").astype(int) - 1
        assert (got.to_numpy() == want.rank(method="dense").astype(int).to_numpy() - 1).all()


def test_spearman_of_undefined_is_zero(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.5, 2.0), (2, 1.0, 1.0)], "g int, y_true double, y_pred double")
    got = {r.g: r.ic for r in metrics.information_coefficient(df, ["g"]).collect()}
    assert got == {1: 0.0, 2: 0.0}
