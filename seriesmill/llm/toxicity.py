"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: one of its hashed form in lower case, and the mean of the vectors of
its hashed letter triples, so words made from a known stem are recognised.  A window of `LENGTH`
words is read in both directions by gated recurrent units, the states are pooled by attention,
and a linear layer gives the log-odds of the window.  Windows start every `STEP` words over the
whole text, so they overlap and each word is in at least two unless the text ends; the score of
a text is that of its worst window.

Only documents are labelled, not windows.  Training therefore alternates: all windows of the
sample are scored, each document is represented by its worst window (clean ones also by random
ones), and the network is fitted to these by backpropagation through time with Adam, all in
numpy.  The sample is bounded: `SAMPLE` documents of each label in the order of a hash of their
id, so the fit costs the same for any corpus.  Nothing but the text enters a score.

Defined results: null and empty texts and texts without words have one window without words; if no
labelled document of some class may be learned from, every score is 0; every row gives one row;
labels that are null are not learned from, and a document with different labels counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of

LENGTH, STEP = 24, 12
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 13
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 12, 8
#: documents of each label that are learned from at most
SAMPLE = 1500
ROUNDS, EPOCHS, RATE = 6, 4, 0.01
CHUNK = 4096


def new_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_SIZE + CHAR_SIZE
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {
        "word": make(WORD_ROWS, WORD_SIZE, scale=0.01),
        "char": make(CHAR_ROWS, CHAR_SIZE, scale=0.3),
        "attend": make(2 * HIDDEN, scale=0.3),
        "out": make(2 * HIDDEN, scale=0.5),
        "bias": np.zeros(1, dtype=np.float32),
    }
    for side in ("f", "b"):
        w[f"in_{side}"] = make(size, 3 * HIDDEN, scale=size**-0.5)
        w[f"add_{side}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        w[f"rec_{side}"] = make(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of a block: row of the word table and letter triples of each."""

    def __init__(self, block: words_of.Block):
        _, first, self.which = np.unique(block.hashes, return_index=True, return_inverse=True)
        self.rows = (block.hashes[first] >> np.uint64(20)).astype(np.int64) % WORD_ROWS
        starts, ends = block.starts[first], block.ends[first]
        lengths = ends - starts
        # letters of the distinct words one after another, in lower case
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        within = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], lengths)
        raw = block.data[np.repeat(starts, lengths) + within].astype(np.uint32)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        before, after = np.zeros_like(raw), np.zeros_like(raw)
        before[1:], after[:-1] = raw[:-1], raw[1:]
        before[self.bounds[:-1]] = 1
        after[self.bounds[1:] - 1] = 2
        code = (before << np.uint32(16)) | (raw << np.uint32(8)) | after
        self.triples = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)

    def vectors(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(self.rows):
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), dtype=np.float32)
        sums = np.add.reduceat(w["char"][self.triples], self.bounds[:-1], axis=0)
        return np.concatenate((w["word"][self.rows], sums / np.diff(self.bounds)[:, None].astype(np.float32)), axis=1)


def window_starts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and owner of all windows of texts with word offsets `words`, and its words."""
    sizes = np.diff(words)
    counts = np.maximum(1, -(-(sizes - LENGTH) // STEP) + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.maximum(np.minimum(turn * STEP, sizes[owner] - LENGTH), 0)
    return words[owner] + inside, owner, np.minimum(sizes[owner], LENGTH)


def _read(gates: np.ndarray, index: np.ndarray, real: np.ndarray, rec: np.ndarray, order: range, keep: list | None = None) -> np.ndarray:
    """States of one direction for windows of word indices; gates holds the input part by word."""
    n, h = len(index), HIDDEN
    states = np.zeros((LENGTH, n, h), dtype=np.float32)
    state = np.zeros((n, h), dtype=np.float32)
    for t in order:
        x = gates[index[:, t]]
        mixed = state @ rec
        both = _sigmoid(x[:, : 2 * h] + mixed[:, : 2 * h])
        reset, update = both[:, :h], both[:, h:]
        fresh = np.tanh(x[:, 2 * h :] + reset * mixed[:, 2 * h :])
        mask = real[:, t : t + 1]
        new = np.where(mask, update * state + (1 - update) * fresh, state)
        if keep is not None:
            keep.append((t, state, reset, update, fresh, mixed[:, 2 * h :]))
        state = new
        states[t] = state
    return states


def _pool(states: np.ndarray, real: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention, pooled states and log-odds from the states of both directions."""
    level = states @ w["attend"]
    level = np.where(real.T, level, -1e4)
    level = np.exp(level - level.max(axis=0))
    attention = level / level.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", attention, states)
    return attention, pooled, pooled @ w["out"] + w["bias"][0]


def _gather(which: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of windows and which places hold a word."""
    place = np.arange(LENGTH)
    real = place < sizes[:, None]
    at = np.where(real, first[:, None] + place, 0)
    return (which[at] if len(which) else np.zeros_like(at)), real


def log_odds(which: np.ndarray, vectors: np.ndarray, first: np.ndarray, sizes: np.ndarray, w: dict) -> np.ndarray:
    """Log-odds of all windows of one block."""
    if not len(vectors):
        vectors = np.zeros((1, WORD_SIZE + CHAR_SIZE), dtype=np.float32)
    gates = {side: vectors @ w[f"in_{side}"] + w[f"add_{side}"] for side in ("f", "b")}
    out = np.empty(len(first), dtype=np.float32)
    for low in range(0, len(first), CHUNK):
        part = slice(low, low + CHUNK)
        index, real = _gather(which, first[part], sizes[part])
        forward = _read(gates["f"], index, real, w["rec_f"], range(LENGTH))
        backward = _read(gates["b"], index, real, w["rec_b"], range(LENGTH - 1, -1, -1))
        out[part] = _pool(np.concatenate((forward, backward), axis=2), real, w)[2]
    return out


def text_log_odds(texts: pa.Array, w: dict) -> np.ndarray:
    """Log-odds of the worst window of each text."""
    parts = []
    for block in words_of.blocks(texts, lower=True):
        words = Words(block)
        first, owner, sizes = window_starts(block.words)
        odds = log_odds(words.which, words.vectors(w), first, sizes, w)
        starts = np.searchsorted(owner, np.arange(block.n))
        parts.append(np.maximum.reduceat(odds, starts))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)


def gradients(words: Words, first: np.ndarray, sizes: np.ndarray, label: np.ndarray, w: dict, drop: np.ndarray | None = None) -> tuple[float, dict]:
    """Mean logistic loss of windows and its gradient for every weight."""
    n, h = len(first), HIDDEN
    index, real = _gather(words.which, first, sizes)
    used, index = np.unique(index, return_inverse=True)
    index = index.reshape(n, LENGTH)
    lengths = np.diff(words.bounds)[used] if len(words.rows) else np.ones(1, dtype=np.int64)
    spread = np.repeat(np.arange(len(used)), lengths)
    within = np.arange(len(spread)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    triples = words.triples[np.repeat(words.bounds[:-1][used], lengths) + within] if len(words.rows) else np.zeros(1, dtype=np.int64)
    rows = words.rows[used] if len(words.rows) else np.zeros(1, dtype=np.int64)
    own = w["word"][rows] * (1 if drop is None else drop[: len(used), None])
    letters = np.add.reduceat(w["char"][triples], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None].astype(np.float32)
    x = np.concatenate((own, letters), axis=1)

    tape: dict[str, list] = {"f": [], "b": []}
    orders = {"f": range(LENGTH), "b": range(LENGTH - 1, -1, -1)}
    states = np.concatenate([_read(x @ w[f"in_{s}"] + w[f"add_{s}"], index, real, w[f"rec_{s}"], orders[s], tape[s]) for s in ("f", "b")], axis=2)
    attention, pooled, odds = _pool(states, real, w)
    p = _sigmoid(odds)
    loss = float(-np.mean(np.where(label > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    g: dict[str, np.ndarray] = {}
    d_odds = ((p - label) / n).astype(np.float32)
    g["out"], g["bias"] = pooled.T @ d_odds, np.array([d_odds.sum()], dtype=np.float32)
    d_pooled = d_odds[:, None] * w["out"]
    d_attention = np.einsum("tnh,nh->tn", states, d_pooled)
    d_level = attention * (d_attention - (attention * d_attention).sum(axis=0))
    g["attend"] = np.einsum("tn,tnh->h", d_level, states)
    d_states = attention[:, :, None] * d_pooled + d_level[:, :, None] * w["attend"]

    d_x = np.zeros_like(x)
    for k, side in enumerate(("f", "b")):
        rec = w[f"rec_{side}"]
        d_gates = np.zeros((len(x), 3 * h), dtype=np.float32)
        g_rec = np.zeros_like(rec)
        d_state = np.zeros((n, h), dtype=np.float32)
        for t, state, reset, update, fresh, inner in reversed(tape[side]):
            mask = real[:, t : t + 1]
            d_new = np.where(mask, d_states[t][:, k * h : (k + 1) * h] + d_state, 0)
            # where there is no word the state went through unchanged
            d_state = np.where(mask, 0, d_states[t][:, k * h : (k + 1) * h] + d_state)
            d_fresh = d_new * (1 - update) * (1 - fresh**2)
            d_update = d_new * (state - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_in = np.concatenate((d_reset, d_update, d_fresh), axis=1)
            d_mixed = np.concatenate((d_reset, d_update, d_fresh * reset), axis=1)
            np.add.at(d_gates, index[:, t], d_in)
            g_rec += state.T @ d_mixed
            d_state += d_new * update + d_mixed @ rec.T
        g[f"rec_{side}"] = g_rec
        g[f"in_{side}"] = x.T @ d_gates
        g[f"add_{side}"] = d_gates.sum(axis=0)
        d_x += d_gates @ w[f"in_{side}"].T
    g["word"] = np.zeros_like(w["word"])
    np.add.at(g["word"], rows, d_x[:, :WORD_SIZE] * (1 if drop is None else drop[: len(used), None]))
    g["char"] = np.zeros_like(w["char"])
    np.add.at(g["char"], triples, (d_x[:, WORD_SIZE:] / lengths[:, None])[spread])
    return loss, g


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.first = {k: np.zeros_like(v) for k, v in w.items()}
        self.second = {k: np.zeros_like(v) for k, v in w.items()}
        self.step = 0

    def update(self, w: dict, g: dict, rate: float) -> None:
        self.step += 1
        size = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k in w:
            self.first[k] += 0.1 * (g[k] - self.first[k])
            self.second[k] += 0.001 * (g[k] ** 2 - self.second[k])
            w[k] -= (rate * size) * self.first[k] / (np.sqrt(self.second[k]) + 1e-7)


def _one_block(texts: list[str | None]) -> words_of.Block:
    """All texts of the sample as one block."""
    found = list(words_of.blocks(pa.array(texts, pa.large_string()), lower=True))
    shift = np.cumsum([0] + [len(b.data) for b in found])
    count = np.cumsum([0] + [len(b.hashes) for b in found])
    join = lambda name, by: np.concatenate([getattr(b, name) + s for b, s in zip(found, by, strict=False)])
    words = np.concatenate([b.words[:-1] + c for b, c in zip(found, count, strict=False)] + [count[-1:]])
    bounds = np.concatenate([b.bounds[:-1] + s for b, s in zip(found, shift, strict=False)] + [shift[-1:]])
    return words_of.Block(0, np.concatenate([b.data for b in found]), bounds, join("starts", shift), join("ends", shift), np.concatenate([b.hashes for b in found]), words)


def train(texts: list[str | None], labels: list[int], seed: int = 3) -> dict[str, np.ndarray]:
    """Weights fitted to labelled texts; the output is calibrated on the worst windows."""
    rng = np.random.default_rng(seed)
    w = new_weights(seed)
    adam = Adam(w)
    block = _one_block(texts)
    words = Words(block)
    first, owner, sizes = window_starts(block.words)
    label = np.array(labels, dtype=np.float32)
    starts = np.searchsorted(owner, np.arange(block.n + 1))
    toxic, clean = np.flatnonzero(label > 0), np.flatnonzero(label == 0)
    for turn in range(ROUNDS):
        odds = log_odds(words.which, words.vectors(w), first, sizes, w) if turn else rng.random(len(first))
        worst = np.array([starts[d] + odds[starts[d] : starts[d + 1]].argmax() for d in range(block.n)])
        chosen = [worst]
        if turn == 0:  # nothing is known yet: some windows of each text
            chosen += [starts[:-1] + (rng.random(block.n) * np.diff(starts)).astype(np.int64) for _ in range(3)]
        else:
            chosen.append(starts[clean] + (rng.random(len(clean)) * np.diff(starts)[clean]).astype(np.int64))
        windows = np.unique(np.concatenate(chosen))
        for epoch in range(EPOCHS):
            rng.shuffle(windows)
            rate = RATE * (1 if turn < ROUNDS - 2 else 0.3)
            for low in range(0, len(windows), 128):
                at = windows[low : low + 128]
                drop = (rng.random(128 * LENGTH + 1) > 0.3).astype(np.float32)
                _, g = gradients(words, first[at], sizes[at], label[owner[at]], w, drop)
                adam.update(w, g, rate)
    odds = log_odds(words.which, words.vectors(w), first, sizes, w)
    worst = np.maximum.reduceat(odds, starts[:-1]).astype(np.float64)
    scale, shift = _calibrate(worst, label, len(toxic), len(clean))
    w["out"], w["bias"] = (w["out"] * scale).astype(np.float32), (w["bias"] * scale + shift).astype(np.float32)
    return w


def _calibrate(odds: np.ndarray, label: np.ndarray, toxic: int, clean: int) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets."""
    target = np.where(label > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(a * odds + b)
        weight = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((p - target) * odds).sum() + 1e-3 * (a - 1), (p - target).sum()])
        curve = np.array([[(weight * odds**2).sum() + 1e-3, (weight * odds).sum()], [(weight * odds).sum(), weight.sum() + 1e-3]])
        move = np.linalg.solve(curve, gradient)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-8:
            break
    return max(a, 0.05), b


def fit(docs: DataFrame, labels: DataFrame, may_learn, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Weights from at most `sample` documents of each label where `may_learn(id)` holds."""
    marked = labels.filter(F.col("toxic").isNotNull() & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "doc_id")
    parts = [marked.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # at most 2 * sample ids
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").collect()
    texts, marks = [r["text"] for r in rows], [int(r["toxic"]) for r in rows]
    return train(texts, marks) if 0 < sum(marks) < len(marks) else None


def score(docs: DataFrame, weights: dict[str, np.ndarray] | None, text_col: str = "text", result: str = "score") -> DataFrame:
    """`docs` without the text and with the score of its worst window."""
    names = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            p = _sigmoid(text_log_odds(batch[text_col], w).astype(np.float64)) if w is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(p)], names=[*names, result])

    schema = docs.drop(text_col).schema.add(result, "double")
    return docs.select(*names, text_col).mapInArrow(run, schema)
