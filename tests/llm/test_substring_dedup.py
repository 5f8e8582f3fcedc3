import random

import numpy as np
import pyarrow as pa
import pytest

import brute_force as plain
from seriesmill.llm import substring_dedup as sd
from seriesmill.llm import text as words_of


def result(docs):
    return {r.doc_id: (r.n_words, r.n_removed, plain.sha(r.kept_text)) for r in sd.remove_repeats(docs).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, hash int").repartition(5)


def words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert result(docs) == plain.repeats_removed([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_over_boundaries_and_runs(spark):
    rng = random.Random(8)
    passages = [words(rng, n) for n in (12, 13, 14, 25, 26, 60, 200)]
    rows = []
    for _ in range(120):
        own = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            low = rng.randrange(len(p))
            own += words(rng, rng.randrange(0, 9)) + (p if rng.random() < 0.5 else p[low : low + rng.randrange(1, 60)])
        rows.append(" ".join(own))
    rows += ["x " * 13, "x " * 12, "x " * 40, "x " * 300, "Only once " * 20, "", None, "  \n", "Case " * 13, "case " * 13]
    rows += ["a b " * 30, "b a " * 30, " ".join(words(rng, 400, 3)), " ".join(words(rng, 400, 3))]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    assert result(frame(spark, pairs)) == plain.repeats_removed(pairs)


def test_null_and_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    start = " ".join(passage.split()[:13])
    docs = frame(spark, [(4, passage), (4, passage), (None, passage), (None, f"{passage} end"), (2, f"start {start}"), (None, None)])
    rows = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert rows == [(-1, 0, 0), (-1, 20, 20), (-1, 21, 20), (2, 14, 0), (4, 20, 13), (4, 20, 13)]
    lone = frame(spark, [(None, passage), (None, passage)])
    assert [r.n_removed for r in sd.remove_repeats(lone).collect()] == [0, 0]


def test_texts_of_one_id_are_judged_apart(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, [(1, passage), (9, f"a b c {passage}"), (9, f"{passage} d e"), (9, "none of the other words are here at all so nothing goes away")])
    rows = sorted((r.n_words, r.n_removed) for r in sd.remove_repeats(docs).collect())
    assert rows == [(13, 0), (30, 0), (32, 30), (33, 30)]


def test_empty_table(spark):
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_anchors_of_equal_windows_are_equal():
    rng = random.Random(3)
    passage = words(rng, 30)
    texts = [" ".join(words(rng, rng.randrange(5, 40)) + passage + words(rng, 9)) for _ in range(20)]
    inside = []
    for t in texts:
        block = next(words_of.blocks(pa.array([t]), False))
        at, anchor, hashes = sd.anchored_windows(block)
        low = len(t.split()) - 9 - 30
        inside.append({(int(a) - low, int(b) - low, int(h)) for a, b, h in zip(at, anchor, hashes) if low <= a <= low + 30 - 13})
    assert all(x == inside[0] for x in inside) and inside[0]


def test_factors_are_greedy_and_boundaries_checked():
    hit = np.array([1, 1, 1, 1, 0, 0, 1, 1], dtype=bool)
    doc = np.array([3, 3, 5, 5, 0, 0, 5, 5])
    parsed, straddling = sd.factors(hit, doc, window=3)
    assert parsed == [(0, 4, 3), (6, 4, 5)] and straddling == [2, 3]
