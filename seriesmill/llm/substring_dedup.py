"""Substring deduplication by relative Lempel-Ziv parsing.

A word goes if it lies in a window of 13 consecutive words that also starts in a document of a
smaller id.  Windows are judged on the input.

0. Copies.  A text equal to one of a smaller id repeats all its windows and takes no further part.
1. Anchors.  Of the five-word sequences in a window of 13 words the one of the least hash is its
   anchor.  So equal windows hold equal anchors at equal places, and one word in five starts an
   anchor.  Only windows whose anchor two documents hold can repeat.
2. Index of reference blocks.  A block is what one task has read.  For its windows with shared
   anchors it lists the smallest id; the lists of all blocks are merged by window hash.  They are combined before the shuffle, so a passage that a third of all
   documents hold costs one row a block.
3. Parsing.  A document looks its windows up and is factored greedily from left to right: a factor
   starts at a window with an earlier reference and grows while the following windows, each of
   which shares 12 words with the one before, have the same reference document; the next factor
   starts at the word after it.
4. Boundaries.  Windows that straddle the ends of factors have no part in any of them, so each is
   checked by its own reference.  Factors of 13 words or more and the straddling windows are the
   duplicate spans.

Windows are compared by 64-bit hashes of their words, exact up to a chance of n * n / 2**65.

Defined results: null and empty texts have no words; rows of the same id, or with a null id, never
repeat each other, and a null id counts as larger than all others; every row gives one row; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of
from seriesmill.llm.shared import cut

WINDOW = 13
ANCHOR = 5
_OWNER = np.uint64(0xD6E8FEB86659FD93)
#: copies up to which their list (50 MB) is broadcast, else it is shuffled
BROADCAST_COPIES = 1 << 20


def anchored_windows(block: words_of.Block, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window inside one text, the first word of its anchor, and its hash."""
    n = len(block.hashes) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    grams = words_of.window_hashes(block.hashes, k)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    owner = block.owners()
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    anchor = at + view[at].argmin(axis=1)
    return at, anchor, grams[anchor]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words_of.blocks(batch["text"], lower=False):
            _, anchor, hashes = anchored_windows(block)
            # each anchor of a text once
            fresh = np.ones(len(anchor), dtype=bool)
            fresh[1:] = anchor[1:] != anchor[:-1]
            owner, hashes = block.owners()[anchor[fresh]], hashes[fresh]
            _, once = np.unique(words_of.mix(hashes + owner.astype(np.uint64) * _OWNER), return_index=True)
            row = pa.array(owner[once] + block.first)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[once].view(np.int64)), batch["key"].take(row)], names=["anchor", "key"])


def _values(column) -> np.ndarray:
    """All values of a list column, whatever slice it is."""
    return column.flatten().to_numpy(zero_copy_only=False)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor is shared: hash, key and first word, once for each text.

    Places of texts without an id, which are no reference, are negative (-1 - place).
    """
    for batch in batches:
        counts = batch["anchors"].value_lengths().to_numpy(zero_copy_only=False)
        known = _values(batch["anchors"]).view(np.uint64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        for block in words_of.blocks(batch["text"], lower=False):
            at, _, hashes = anchored_windows(block)
            own = known[bounds[block.first] : bounds[block.first + block.n]]
            near = at[np.isin(hashes, own)]
            if not len(near):
                continue
            owner = block.owners()[near]
            sums = window_hashes_at(block, near)
            # the first of equal windows of a text
            _, once = np.unique(words_of.mix(sums + owner.astype(np.uint64) * _OWNER), return_index=True)
            once.sort()
            row = pa.array(owner[once] + block.first)
            known_id = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)[owner[once] + block.first]
            place = near[once] - block.words[owner[once]]
            place = np.where(known_id, place, -1 - place)
            yield pa.RecordBatch.from_arrays([pa.array(sums[once].view(np.int64)), batch["key"].take(row), pa.array(place.astype(np.int32))], names=["hash", "key", "place"])


def window_hashes_at(block: words_of.Block, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    scale = words_of.powers(window)
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(window):
        total += block.hashes[at + j] * scale[j]
    return words_of.mix(total)


def factors(hit: np.ndarray, ref_doc: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Greedy parse of one text from the references of its windows.

    Returns factors (first word, words, reference document) and the windows with
    a reference that straddle the end of a factor.
    """
    n = len(hit)
    goes_on = np.zeros(n, dtype=bool)
    goes_on[:-1] = hit[:-1] & hit[1:] & (ref_doc[1:] == ref_doc[:-1])
    stops = np.flatnonzero(~goes_on)
    hits = np.flatnonzero(hit)
    parsed, straddling, i = [], [], 0
    while (at := np.searchsorted(hits, i)) < len(hits):
        i = int(hits[at])
        last = int(stops[np.searchsorted(stops, i)])
        parsed.append((i, last - i + window, int(ref_doc[i])))
        i = last + window
        straddling += hits[np.searchsorted(hits, last + 1) : np.searchsorted(hits, i)].tolist()
    return parsed, straddling


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["hits"]
        filled = lists.fill_null([])
        counts = np.nan_to_num(filled.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        flat = filled.flatten()
        places = flat.field("place").to_numpy(zero_copy_only=False)
        checks = flat.field("check").to_numpy(zero_copy_only=False)
        docs = flat.field("ref_doc").to_numpy(zero_copy_only=False)
        copies = batch["copy_of"].to_pylist()
        for block in words_of.blocks(batch["text"], lower=False):
            raw = block.data.tobytes()
            removed, parses, kept = [], [], []
            for d in range(block.n):
                words = raw[block.bounds[d] : block.bounds[d + 1]].split()
                low, high = bounds[block.first + d], bounds[block.first + d + 1]
                n = len(words) - WINDOW + 1
                parsed: list = []
                copy_of = copies[block.first + d]
                if copy_of is not None and n > 0:
                    parsed = [(0, len(words), copy_of)]
                    removed.append(len(words))
                    words = []
                elif high > low and n > 0:
                    own = window_hashes_at(block, np.arange(block.words[d], block.words[d] + n))
                    place, refs = places[low:high], docs[low:high]
                    # another text of the same id may have found other places
                    mine = np.flatnonzero(place < n)
                    mine = mine[(own[place[mine]] & np.uint64(0xFFFF)) == checks[low:high][mine].astype(np.uint64)]
                    order = mine[np.argsort(own[place[mine]])]
                    # the same window further on is found by its hash
                    slot = np.minimum(np.searchsorted(own[place[order]], own), max(len(order) - 1, 0))
                    hit = own[place[order]][slot] == own if len(order) else np.zeros(n, dtype=bool)
                    parsed, straddling = factors(hit, refs[order][slot] if len(order) else np.zeros(n, dtype=np.int64))
                    keep = np.ones(len(words), dtype=bool)
                    for start, length, _ in parsed:
                        keep[start : start + length] = False
                    for start in straddling:
                        keep[start : start + WINDOW] = False
                    removed.append(len(words) - int(keep.sum()))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    removed.append(0)
                parses.append([{"start": a, "length": b, "ref_doc": c} for a, b, c in parsed])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(block.first, block.n),
                    pa.array(np.diff(block.words)),
                    pa.array(removed, pa.int64()),
                    pa.array(parses, _FACTORS),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "factors", "kept_text"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id`, `n_words`, `n_removed`, `factors`, `kept_text`, one row for each row.

    Factors are (start, length, ref_doc), in words.  `kept_text` holds the words that
    stay, joined by one space.
    """
    number, text = F.col(id_col).cast("long"), F.col(text_col)
    # rows without an id are told apart by their text
    # without an alias the plans of both joins of the texts are equal, and one shuffle serves them
    plain = (id_col, text_col, dict(docs.dtypes)[id_col]) == ("doc_id", "text", "bigint")
    base = docs.select("doc_id", "text") if plain else docs.select(number.alias("doc_id"), text.alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    copies = cut(_copies(base))
    few = copies.count() <= BROADCAST_COPIES
    known = F.broadcast(copies) if few else copies
    marked = base.withColumn("digest", F.md5("text"))
    repeated = marked.join(known, ["key", "digest"]).select("doc_id", "text", "copy_of")
    base = marked.join(known.select("key", "digest"), ["key", "digest"], "left_anti").select("doc_id", "text", "key")

    anchors = base.select("text", "key").mapInArrow(_anchors, "anchor long, key long")
    shared = anchors.groupBy("anchor").count().filter("count > 1").select("anchor")
    held = anchors.join(shared, "anchor").groupBy("key").agg(F.collect_list("anchor").alias("anchors"))
    windows = base.join(held, "key").select("doc_id", "text", "key", "anchors").mapInArrow(_candidates, "hash long, key long, place int")
    index = windows.filter("place >= 0").groupBy("hash").agg(F.min("key").alias("ref_doc"))
    hits = windows.join(index, "hash").filter("place < 0 OR key > ref_doc")
    hit = F.struct(F.expr("if(place < 0, -1 - place, place)").alias("place"), F.expr("cast(hash & 65535 AS int)").alias("check"), "ref_doc")
    hits = hits.groupBy("key").agg(F.collect_list(hit).alias("hits"))
    found = base.join(hits, "key", "left").select("doc_id", "text", "hits", F.lit(None).cast("long").alias("copy_of"))
    nothing = F.lit(None).cast("array<struct<place: int, check: int, ref_doc: long>>").alias("hits")
    return found.unionByName(repeated.select("doc_id", "text", nothing, "copy_of")).mapInArrow(
        _parse,
        "doc_id long, n_words long, n_removed long, factors array<struct<start: int, length: int, ref_doc: long>>, kept_text string",
    )


def _copies(base: DataFrame) -> DataFrame:
    """key, digest and copy_of of texts that are equal to one of a smaller id."""
    texts = base.filter("text IS NOT NULL").select("doc_id", "key", F.md5("text").alias("digest"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")).filter("n > 1 AND copy_of IS NOT NULL")
    again = texts.join(first.drop("n"), "digest").filter("doc_id IS NULL OR doc_id > copy_of")
    return again.select("key", "digest", "copy_of").distinct()
