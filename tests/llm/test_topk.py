import random

import pytest

from seriesmill.llm import queries, topk


def expected(rows, k, is_query):
    import math

    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = tuple(math.floor(256 * x) for x in v)
        usable[i] = min(own, usable.get(i, own))
    out = []
    for q, v in usable.items():
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert got(queries.op5_topk(spark, f"/root/testdata/{sf}")) == expected(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize("coordinate_from", [0.0001, 2.0])
def test_uneven_lengths_ties_and_odd_rows(spark, coordinate_from, monkeypatch):
    monkeypatch.setattr(topk, "COORDINATE_FROM", coordinate_from)
    monkeypatch.setattr(topk, "SEEDS", 7)
    monkeypatch.setattr(topk, "LEAST", 4)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.01, 1, 1, 30]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0]) for i in range(60)]
    rows += [(2000, [0.0] * 6), (2010, [-5.0] * 6), (2001, None), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    rows += [(None, [9.0] * 6), (2020, [1.0, 2.0]), (2030, []), (2040, [1.0, 1.0, 1.0, 1.0, 1.0, 2.0]), (2040, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), rows[5]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, bucket int").repartition(5)
    result = got(topk.top_k(df, lambda i: i % 10 == 0, 5))
    assert result == expected(rows, 5, lambda i: i % 10 == 0)


def test_fewer_than_k_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(topk.top_k(spark.createDataFrame([(50, [1.0]), (51, [2.0])], schema), lambda i: i % 50 == 0)) == [(50, 1, 51, 256 * 512)]
    assert got(topk.top_k(spark.createDataFrame([(50, [1.0])], schema), lambda i: i % 50 == 0)) == []
    assert got(topk.top_k(spark.createDataFrame([], schema), lambda i: i % 50 == 0)) == []


def test_oracle_has_the_same_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = con.execute(queries.ORACLES["op5_topk"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in rows) == got(queries.op5_topk(spark, sf))
