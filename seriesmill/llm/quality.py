"""Quality by weak supervision.

Rules look at counts of a whole text and vote good (1), bad (-1) or abstain (0).  Vote patterns
are counted over all documents; there are at most 3 ** len(RULES) of them, whatever the number of
documents, so expectation-maximisation runs on the pattern counts.  It estimates the share
of good documents and for each rule how often it is right when it votes on a good and on a bad
document.  The posterior probability that a document is good decides.

Defined results: null and empty texts have no words, abstain or vote like any text without words
and fail the base test; rows with null or repeated ids are judged like others; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of
from seriesmill.llm.shared import cut

REPEAT_WINDOW = 8
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letters", "n_capitals", "n_exclaims", "n_marked_words", "n_stutters")

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL = np.zeros(256, dtype=np.int64)
_CAPITAL[65:91] = 1
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = 1
_EXCLAIM = np.zeros(256, dtype=np.int64)
_EXCLAIM[ord("!")] = 1
_SPACES = b" \t\n\x0b\x0c\r"
_CLOSERS = (b".", b"!", b"?", b'"', b":", b";", b"\xe2\x80\x9d", b"\xc2\xbb")


def _per_text(block: words_of.Block, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[block.bounds[1:]] - total[block.bounds[:-1]]


def repeated_words(block: words_of.Block, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows of k words that its text holds twice or more."""
    first, hashes = block.windows(k)
    covered = np.zeros(len(block.hashes) + 1, dtype=np.int64)
    if len(first):
        owner = block.owners()
        keys = words_of.mix(hashes + owner[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        twin = np.zeros(len(keys), dtype=bool)
        same = ordered[1:] == ordered[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        at = first[order[twin]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + k, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    return inside[block.words[1:]] - inside[block.words[:-1]]


def _marked_words(block: words_of.Block) -> np.ndarray:
    """Words of each text that hold a symbol."""
    total = np.concatenate(([0], np.cumsum(_SYMBOL[block.data])))
    marked = np.concatenate(([0], np.cumsum(total[block.ends] > total[block.starts])))
    return marked[block.words[1:]] - marked[block.words[:-1]]


def _stutters(block: words_of.Block) -> np.ndarray:
    """Words of each text that equal the one before."""
    owner = block.owners()
    again = np.zeros(len(owner) + 1, dtype=np.int64)
    if len(owner) > 1:
        again[2:] = np.cumsum((block.hashes[1:] == block.hashes[:-1]) & (owner[1:] == owner[:-1]))
    return again[block.words[1:]] - again[block.words[:-1]]


def signals(texts: pa.Array) -> np.ndarray:
    """One row for each text, the columns of SIGNALS."""
    parts = []
    for block in words_of.blocks(texts, lower=False):
        data = block.data
        solid = ~words_of.SPACE[data] & ((data & 0xC0) != 0x80)
        lines = np.zeros((block.n, 3), dtype=np.int64)
        raw = data.tobytes()
        for i, (low, high) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
            seen = set()
            for line in raw[low:high].split(b"\n"):
                bare = line.strip(_SPACES)
                if bare:
                    lines[i, 0] += 1
                    lines[i, 1] += bare.endswith(_CLOSERS)
                    lines[i, 2] += line in seen
                    seen.add(line)
        columns = [
            np.diff(block.words), _per_text(block, solid), _per_text(block, _SYMBOL[data]), lines[:, 2], repeated_words(block),
            lines[:, 0], lines[:, 1], _per_text(block, _LETTER[data]), _per_text(block, _CAPITAL[data]), _per_text(block, _EXCLAIM[data]), _marked_words(block), _stutters(block),
        ]
        parts.append(np.stack(columns, axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(SIGNALS)), dtype=np.int64)


def base_failed(x: np.ndarray) -> np.ndarray:
    return (x[:, 0] < 20) | (100 * x[:, 4] > 30 * x[:, 0])


def _share(part: int, whole: int, good: float, bad: float, least: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """Vote on column part / column whole: good up to one limit, bad from another on."""

    def vote(x: np.ndarray) -> np.ndarray:
        ratio = x[:, part] / np.maximum(x[:, whole], 1)
        known = x[:, whole] >= least
        return np.where(known & (ratio <= good), 1, np.where(known & (ratio >= bad), -1, 0))

    return vote


def _length(x: np.ndarray) -> np.ndarray:
    return np.where(x[:, 0] >= 40, 1, np.where(x[:, 0] < 20, -1, 0))


def _word_length(x: np.ndarray) -> np.ndarray:
    mean = x[:, 1] / np.maximum(x[:, 0], 1)
    known = x[:, 0] >= 5
    return np.where(known & (mean >= 3) & (mean <= 9), 1, np.where(known & ((mean < 2) | (mean > 12)), -1, 0))


def _closed(x: np.ndarray) -> np.ndarray:
    share = x[:, 6] / np.maximum(x[:, 5], 1)
    known = x[:, 5] >= 1
    return np.where(known & (share >= 0.5), 1, np.where(known & (share <= 0.1), -1, 0))


#: names and votes, in the order of the vote pattern
RULES: tuple[tuple[str, Callable[[np.ndarray], np.ndarray]], ...] = (
    ("length", _length),
    ("word_length", _word_length),
    ("symbols", _share(2, 0, 0.05, 0.15, 10)),
    ("duplicate_lines", _share(3, 5, 0.05, 0.4, 3)),
    ("repeated_words", _share(4, 0, 0.1, 0.25, 10)),
    ("closed_lines", _closed),
    ("capitals", _share(8, 7, 0.2, 0.5, 20)),
    ("exclaims", _share(9, 0, 0.05, 0.2, 10)),
    ("marked_words", _share(10, 0, 0.05, 0.2, 10)),
    ("stutters", _share(11, 0, 0.05, 0.2, 10)),
)


def votes(x: np.ndarray) -> np.ndarray:
    return np.stack([vote(x) for _, vote in RULES], axis=1) if len(x) else np.zeros((0, len(RULES)), dtype=np.int64)


def pattern_codes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(len(RULES)))


def patterns(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**j % 3 - 1 for j in range(len(RULES))], axis=1)


#: votes of imagined evidence for the first accuracies, on good and on bad documents
IMAGINED = (50.0, 5.0)


def expectation_maximisation(v: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> dict:
    """Prior and accuracies of the rules from vote patterns and their counts.

    A rule that abstains says nothing.  A rule is right on most good documents, which fixes the
    meaning of the classes: accuracies on good documents start at 0.98, with `IMAGINED` votes of
    evidence for it at any amount of data.  Of the bad ones a rule may know only some kind.
    """
    good, bad = (v == 1).astype(float), (v == -1).astype(float)
    right = np.stack([np.full(v.shape[1], 0.98), np.full(v.shape[1], 0.4)])  # on good, on bad documents
    prior = 0.85
    weight = counts.astype(float)
    for _ in range(rounds):
        post = posterior(v, prior, right)
        new_prior = float((weight * post).sum() / weight.sum())
        new_right = np.empty_like(right)
        for k, (own, hit, miss) in enumerate(((post, good, bad), (1 - post, bad, good))):
            mass = (weight * own) @ hit
            imagined, mean = (IMAGINED[k], (0.98, 0.4)[k])
            new_right[k] = (mass + imagined * mean) / (mass + (weight * own) @ miss + imagined)
        new_right = new_right.clip(0.05, 0.999)
        new_prior = min(max(new_prior, 0.02), 0.98)
        moved = max(abs(new_prior - prior), float(np.abs(new_right - right).max()))
        prior, right = new_prior, new_right
        if moved < tolerance:
            break
    return {"prior": prior, "right": right}


def posterior(v: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    good, bad = (v == 1).astype(float), (v == -1).astype(float)
    log_odds = math.log(prior / (1 - prior))
    log_odds = log_odds + good @ np.log(right[0] / (1 - right[1])) + bad @ np.log((1 - right[0]) / right[1])
    return 1 / (1 + np.exp(-log_odds))


def judge(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Posterior and verdict of each row of signals."""
    p = posterior(votes(x), model["prior"], model["right"]) if len(x) else np.zeros(0)
    return p, ~base_failed(x) & (p >= 0.5)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id`, those of SIGNALS and the vote pattern of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = signals(batch["text"])
            codes = pattern_codes(votes(x)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in x.T), pa.array(codes)], names=["doc_id", *SIGNALS, "pattern"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in SIGNALS) + ", pattern int"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fit(measured: DataFrame) -> dict:
    """The model of all measured rows; at most 3 ** len(RULES) pattern counts reach the driver."""
    rows = measured.groupBy("pattern").count().collect()
    if not rows:
        return {"prior": 0.85, "right": np.stack([np.full(len(RULES), 0.98), np.full(len(RULES), 0.4)])}
    rows.sort(key=lambda r: r["pattern"])
    return expectation_maximisation(patterns(np.array([r["pattern"] for r in rows])), np.array([r["count"] for r in rows]))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, the signals, `base_failed`, `posterior` (of good quality) and `kept`."""
    measured = cut(measure(docs, id_col, text_col))
    model = fit(measured)
    codes = np.arange(3 ** len(RULES))
    p = posterior(patterns(codes), model["prior"], model["right"])
    # at most 3 ** len(RULES) numbers
    table = F.array(*[F.lit(float(x)) for x in p]) if len(p) <= 1 else F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in p) + "]"), "array<double>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.withColumn("base_failed", failed)
        .withColumn("posterior", F.element_at(table, F.col("pattern") + 1))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `assess` keeps, unchanged, with all their columns.

    The verdict is made again on the row itself, so repeated or null ids do not matter.
    """
    model = fit(measure(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, kept = judge(signals(batch[text_col]), model)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
