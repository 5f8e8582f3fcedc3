import math
import random

import numpy as np
import pytest

from brute_force import sha
from seriesmill.llm import centroids, queries


def expected(rows, k=8, rounds=10):
    """Rows of the query by plain Python, for ids that may repeat."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}") if r[0] is not None else "", r[1]))
    middle = [list(v) for _, v in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in middle] for _, v in kept]
        return [min((d, c) for c, d in enumerate(own)) for own in far]

    for _ in range(rounds if kept else 0):
        found = assign()
        for c in range(len(middle)):
            own = [v for (_, v), (_, b) in zip(kept, found, strict=True) if b == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign() if kept else []
    inertia = {c: sum(d for d, b in found if b == c) for c in range(len(middle))}
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, middle[c])))) for (i, _), (d, c) in zip(kept, found, strict=True)),
        key=repr,
    )


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=repr)


def query(df):
    from pyspark.sql import functions as F

    return centroids.cluster(df).withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256))


def test_table_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    result = got(queries.op11_centroids(spark, sf))
    assert result == expected([(r.vec_id, list(r.embedding)) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = con.execute(queries.ORACLES["op11_centroids"]).fetchall()
    names = [d[0] for d in con.description]
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr) == result


def test_transform_keeps_distances():
    turn = centroids.hadamard()
    assert (turn @ turn.T == 64 * np.eye(64, dtype=int)).all()
    assert ((turn[:, 1:] != turn[:, :-1]).sum(1) == np.arange(64)).all()


@pytest.mark.parametrize("spread", [0, 1, 1000, 10**6])
def test_search_gives_up_no_nearest_centroid(spread):
    rng = np.random.default_rng(spread)
    turn = centroids.hadamard()
    middle = rng.integers(-1000, 1000, (8, 64))
    middle[5] = middle[2]
    x = np.concatenate([rng.integers(-1000 - spread, 1001 + spread, (500, 64)), middle, (middle[:4] + middle[4:]) // 2])
    far = ((x[:, None, :] - middle[None]) ** 2).sum(2)
    best, distance = centroids.nearest(x @ turn.T, middle @ turn.T)
    assert (best == far.argmin(1)).all() and (distance == 64 * far.min(1)).all()


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(64)]) for i in range(40)]
    rows += [(i, [1.0] * 64) for i in range(100, 160)]  # ties and repeated vectors
    rows += rows[:5] + [(3, [9.0] * 64), (None, [0.5] * 64), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65)]
    rows += [(204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v string, id int, cluster int").repartition(5)
    assert got(query(df)) == expected(rows)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert got(query(spark.createDataFrame(few, schema))) == expected(few)
    assert got(query(spark.createDataFrame([(1, None)], schema))) == []
    assert got(query(spark.createDataFrame([], schema))) == []


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")).collect()
