import random
import zlib

import numpy as np
import pyarrow as pa

from seriesmill.llm import queries, toxicity as tox
from seriesmill.llm import text as words_of


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 23, 24, 25, 36, 37, 100):
        first, owner, sizes = tox.window_starts(np.array([0, n]))
        seen = np.zeros(n, dtype=int)
        for a, s in zip(first, sizes):
            seen[a : a + s] += 1
        assert len(first) >= 1 and (owner == 0).all() and (seen >= 1).all()
        assert n <= 36 or (seen[12:-12] >= 2).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    block = next(words_of.blocks(pa.array(["the quick brown fox jumps over a lazy dog " * 4, "bad words here"]), True))
    words = tox.Words(block)
    first, owner, sizes = tox.window_starts(block.words)
    label = np.array([0.0, 1.0])[owner]
    w = {k: v.astype(np.float64) for k, v in tox.new_weights(2).items()}
    _, g = tox.gradients(words, first, sizes, label, w)
    for name, values in w.items():
        flat, own = values.reshape(-1), np.asarray(g[name]).reshape(-1)
        for at in [*np.argsort(-np.abs(own))[:3], int(rng.integers(len(flat)))]:
            was = flat[at]
            flat[at] = was + 1e-3
            up = tox.gradients(words, first, sizes, label, w)[0]
            flat[at] = was - 1e-3
            down = tox.gradients(words, first, sizes, label, w)[0]
            flat[at] = was
            assert abs((up - down) / 2e-3 - own[at]) < 2e-4 + 2e-2 * abs(own[at]), name


def test_score_of_a_text_does_not_depend_on_its_neighbours():
    w = tox.new_weights(5)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bc", "Def", "gh!"]) for _ in range(rng.randrange(90))) for _ in range(50)] + [None, "", " ", "A bc"]
    whole = tox.text_log_odds(pa.array(texts), w)
    alone = np.concatenate([tox.text_log_odds(pa.array([t], pa.string()), w) for t in texts])
    assert np.abs(whole - alone).max() < 1e-4


def test_learns_planted_stems():
    rng = random.Random(7)

    def text(bad):
        own = ["".join(rng.choice(["ka", "mo", "ti", "re", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        for _ in range(3 if bad else 0):
            own[rng.randrange(len(own))] = "zlox" + rng.choice(["ka", "mo", "ti", "re", "su", "an", "ed"])
        return " ".join(own)

    labels = [k % 2 for k in range(300)]
    w = tox.train([text(k) for k in labels], labels)
    odds = tox.text_log_odds(pa.array([text(k % 2) for k in range(200)]), w)
    assert ((odds > 0) == (np.arange(200) % 2 == 1)).mean() > 0.95


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    far = [r for r in rows if r.held_out and r.doc_id in labels]
    bad = np.array([labels[r.doc_id] for r in far])
    marked = np.array([r.predicted for r in far])
    assert marked[bad == 1].mean() > 0.6 and marked[bad == 0].mean() < 0.03


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None)], "doc_id long, text string, score string")
    w = tox.new_weights(1)
    rows = tox.score(docs.drop("score"), w).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert tox.score(docs, w, result="toxic").columns == ["doc_id", "score", "toxic"]
    assert tox.score(docs.limit(0), w, result="toxic").count() == 0
    labels = spark.createDataFrame([(1, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    none = tox.fit(docs.drop("score"), labels, lambda i: i.isNotNull())
    assert none is None and {r.score for r in tox.score(docs.drop("score"), none).collect()} == {0.0}
