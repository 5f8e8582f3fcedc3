import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute_force as plain
from seriesmill.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, blocks int, place string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA).repartition(5)


def uneven(spark):
    rows = [(k * 1000 + i, "w " * (1 + (i * 7 + k) % 40), f"s{k}") for k, n in enumerate((600, 200, 60, 20)) for i in range(n)]
    return rows, make(spark, rows)


def weights_of(tokens, alpha):
    total = sum(tokens.values())
    raw = {s: (t / total) ** alpha for s, t in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def test_word_count(spark):
    texts = ["", None, " ", "a", " a  b\tc\n\x0bd\x0ce\rf ", "é x\x1cy"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.n for r in df.select("i", mixing.word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(plain.WORDS.findall(t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("target", [0.75, 0.9, 0.98, 1.0])
def test_exponent_meets_entropy(spark, target):
    tokens = {"a": 9000, "b": 700, "c": 200, "d": 100}
    df = spark.createDataFrame([(s, t) for s, t in tokens.items()], "__source string, tokens long")
    got, alpha = mixing.temperature_weights(df, 10_000, target, None)
    w = {r["__source"]: r.weight for r in got.collect()}
    assert abs(sum(w.values()) - 1) < 1e-9 and all(abs(w[s] - x) < 1e-9 for s, x in weights_of(tokens, alpha).items())
    assert abs(entropy(w) / math.log(4) - target) < 1e-6


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0, 40.0])
def test_exponent_keeps_the_repetition_limit(spark, limit):
    tokens = {"a": 9000, "b": 700, "c": 200, "d": 100}
    df = spark.createDataFrame([(s, t) for s, t in tokens.items()], "__source string, tokens long")
    got, alpha = mixing.temperature_weights(df, 10_000, None, limit)
    most = max(r.weight * 10_000 / tokens[r["__source"]] for r in got.collect())
    assert most <= limit * (1 + 1e-6)
    assert alpha in (0.0, 1.0) or most > limit * (1 - 1e-4)


def test_draws_meet_the_quota(spark):
    rows, df = uneven(spark)
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    tokens = defaultdict(int)
    for i in size:
        tokens[source[i]] += size[i]
    got = mixing.mix(df, max_repeats=3.0, target_entropy=0.9).collect()
    weight = {r.source: r.weight for r in got}
    drawn, passes = defaultdict(int), defaultdict(list)
    for r in got:
        drawn[r.source] += size[r.doc_id]
        passes[r.doc_id].append(r["pass"])
    budget = sum(tokens.values())
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in passes.values())
    for s, t in tokens.items():
        wanted = min(weight[s] * budget, 3.0 * t)
        assert wanted - 41 <= drawn[s] <= wanted + 1e-6
        counts = {len(passes.get(i, [])) for i in size if source[i] == s}
        assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("seed", range(4))
def test_no_document_that_is_left_would_fit(spark, seed):
    # long documents among short ones, one size that many share
    sizes = [1 + (i * 13) % 9 for i in range(90)] + [700, 650, 600, 550, 900] + [10] * 40
    rows = [(k * 1000 + i, "w " * n, f"s{k}") for k in range(3) for i, n in enumerate(sizes[:: k + 1])]
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    got = mixing.mix(make(spark, rows), target_entropy=0.999, max_repeats=None, seed=seed, budget=sum(size.values()) * 7 // 5)
    report = {r.source: r for r in mixing.realised(got).collect()}
    times = defaultdict(int)
    for r in got.collect():
        times[r.doc_id] += 1
    for s, r in report.items():
        own = {i: times[i] for i in size if source[i] == s}
        assert r.drawn == sum(n * size[i] for i, n in own.items()) <= r.wanted
        assert max(own.values()) - min(own.values()) <= 1
        left = [size[i] for i, n in own.items() if n == min(own.values())] if len(set(own.values())) > 1 else []
        assert not left or r.wanted - r.drawn < min(left)


def test_odd_rows(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", "x"), (4, "f g h i", ""), (5, "j", "x")]
    got = mixing.mix(make(spark, rows), target_entropy=None, max_repeats=1.0)
    assert sorted((r.doc_id or -1, r.source or "-") for r in got.collect()) == [(-1, "x"), (1, "-"), (1, "-"), (4, "-"), (5, "x")]
    again = mixing.mixed_rows(make(spark, rows), target_entropy=None, max_repeats=1.0)
    assert again.columns == ["doc_id", "text", "source", "blocks", "place"] and again.count() == 5
    assert mixing.mix(make(spark, [])).count() == 0 and mixing.mix(make(spark, [(1, None, "x")])).count() == 0


def test_plan_has_no_python(spark):
    plan = queries.op8_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = {r.doc_id: len(plain.WORDS.findall(r.text or "")) for r in docs.collect()}
    got = queries.op8_mixing(spark, SF).collect()
    total = sum(size.values())
    drawn = sum(size[r.doc_id] for r in got)
    sources = {r.source: r.weight for r in got}
    assert drawn <= total and drawn >= 0.999 * total and abs(sum(sources.values()) - 1) < 1e-9
    assert entropy(sources) / math.log(len(sources)) >= 0.98 - 1e-6
