import random

import numpy as np
import pytest

import brute_force as plain
from seriesmill.llm import near_dedup as nd
from seriesmill.llm.graph import components


def result(docs):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect()}


def expected(rows):
    return {i: (n, c, c == i) for i, (n, c) in plain.near_duplicates(rows).items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, label int").repartition(5)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert result(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [512, 4])
def test_chains_hot_copies_and_borderline_clusters(spark, block, monkeypatch):
    monkeypatch.setattr(nd, "SET_BLOCK", block)
    monkeypatch.setattr(nd, "SIGNATURE_BLOCK", block)
    rng = random.Random(11)
    rows, base = [], words(rng, 60)
    for _ in range(40):  # exact copies but for case and spaces
        rows.append(" ".join(base).upper().replace(" ", "  ") if rng.random() < 0.5 else " ".join(base))
    for _ in range(60):  # each differs from the base and more from each other
        own = list(base)
        own[rng.randrange(60)] = "edit%d" % rng.randrange(10**6)
        if rng.random() < 0.5:
            own[rng.randrange(60)] = "edit%d" % rng.randrange(10**6)
        rows.append(" ".join(own))
    chain = words(rng, 80)  # neighbours are linked, ends are not
    for k in range(40):
        rows.append(" ".join(chain))
        chain = chain[2:] + words(rng, 2)
    passage = words(rng, 30)  # shared by texts that are not near copies
    rows += [" ".join(passage + words(rng, 20 + k % 20)) for k in range(60)]
    rows += [" ".join(words(rng, rng.randrange(1, 40))) for _ in range(60)]
    rows += ["", None, "   ", "one", "one", "ONE two", "one two", "a b c d", "a b c d e", "a b c d e"]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    assert result(frame(spark, pairs)) == expected(pairs)


def test_null_and_repeated_ids(spark):
    same = "this is the same text of nine words here"
    docs = frame(spark, [(5, same), (5, same), (None, same), (None, "other text that is alone in the table"), (3, None), (3, None), (7, same)])
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in nd.near_duplicates(docs).collect())
    assert rows == [(-1, -1, True), (-1, 5, False), (3, 3, True), (3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 5]


def test_empty_table(spark):
    assert nd.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_few_similar_pairs_are_missed():
    rng = np.random.default_rng(4)
    need, missed, shared = nd.least_matches(), 0, 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
        a, b = np.unique(pool[:600]), np.unique(pool[86:686])  # 514 of 686: just under 0.75
        one, two = nd.signature(a)[None], nd.signature(b)[None]
        shared += bool((nd.band_keys(one) == nd.band_keys(two)).any())
        missed += len(nd.plausible(one, two, need)) == 0
    assert missed == 0 and shared >= 299


def test_bounds_prune_unlike_pairs():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 32, (200, nd.MINIMA), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert len(nd.plausible(a, b, nd.least_matches())) < 3
