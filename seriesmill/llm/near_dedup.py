"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts become sets of distinct five-word shingles.  Equal sets are one node.
2. Nodes get a signature of 128 minima and meet in 32 bands of four.  Two sets of similarity
   0.75 share no band with probability 5e-6.
3. A candidate pair is compared in batches of 16 minima.  With m of n minima equal and a uniform
   prior, the similarity has a beta distribution; the pair is dropped as soon as the chance of
   `LEAST` or more falls under `MISS`.
4. Surviving pairs are verified on the full sets.

Pairs are never listed for a whole bucket.  First every node of a bucket meets the first node of
it (one pair a row), which settles groups of like copies whatever their size.  Buckets whose other
nodes are still in different components are then compared in blocks inside tasks, only between
components, and give a forest of plausible links.  Within the trees of that forest full sets are
compared in blocks: all nodes outside the largest component with each other and with that
component.  So each link that shares a band is found or lies within a component, no bucket is
capped, and no task holds more than two blocks.

Defined results: null and empty texts and texts without words have no set, no links and their own
id as component; equal rows get equal results; documents with a null id count as larger than all
others when the smallest id of a component is taken, and keep a null component if there is no
other id; rows are kept where their id is that of the component, or where that is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of
from seriesmill.llm.graph import components
from seriesmill.llm.shared import OUT_ROWS, cut, release, sorted_groups

WORDS = 5
LEAST = 0.75
MISS = 1e-6
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BATCH = 16
#: nodes of a block when signatures are compared, and when full sets are
SIGNATURE_BLOCK, SET_BLOCK = 512, 256
#: distinct keys up to which a table of keys (16 MB) is broadcast, else it is shuffled
BROADCAST_KEYS = 1 << 20

_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_ODD = (_RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND_SALT = words_of.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(texts: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    for block in words_of.blocks(texts, lower=True):
        n = len(block.hashes) - k + 1
        hashes = words_of.window_hashes(block.hashes, k) if n > 0 else np.empty(0, dtype=np.uint64)
        bounds = block.words.tolist()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low >= k:
                yield np.unique(hashes[low : high - k + 1])
            elif high > low:
                yield words_of.window_hashes(block.hashes[low:high], high - low)
            else:
                yield np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over a set that is not empty, 16 bits of it."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for low in range(0, len(x), 2048):
        np.minimum(least, ((x[None, low : low + 2048] ^ _XOR) * _ODD).min(axis=1), out=least)
    # different minima fall together once in 65,536 times, which only adds candidates
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each row and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.zeros((len(signatures), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        total = words_of.mix(total + parts[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
    return words_of.mix(total ^ _BAND_SALT).view(np.int64)


def least_matches(least: float = LEAST, miss: float = MISS) -> np.ndarray:
    """For n = BATCH, 2 * BATCH, ... the fewest equal minima with which a pair goes on.

    The posterior chance of a similarity of `least` or more after m of n equal is that of
    Beta(m + 1, n - m + 1), which is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def plausible(left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of signatures (right may be one row) survive all batches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for i, least in enumerate(need):
        at = slice(i * BATCH, (i + 1) * BATCH)
        other = right[alive, at] if len(right) == len(left) else right[:, at]
        matches[alive] += (left[alive, at] == other).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity: 100 * intersection >= 75 * union."""
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, MINIMA)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest of the set, its size and signature."""
    for batch in batches:
        for low in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(low, OUT_ROWS)
            sets = list(shingle_sets(part["text"]))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "signature"],
            )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, OUT_ROWS):
            sets = [s for s in shingle_sets(batch["text"].slice(low, OUT_ROWS)) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["digest", "shingles"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(low, OUT_ROWS)
            keys = band_keys(_signatures(part["signature"]))
            node = part["node"].take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), node], names=["band", "node"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for batch in batches:
        if batch.num_rows:
            alive = plausible(_signatures(batch["signature_a"]), _signatures(batch["signature_b"]), need)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = ([np.frombuffer(x, dtype=np.uint64) for x in batch[c].to_pylist()] for c in ("shingles_a", "shingles_b"))
        keep = pa.array([linked(a, b) for a, b in zip(one, two, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch[c].filter(keep) for c in ("a", "b")], names=["a", "b"])


class _Forest:
    """Union of the components met in one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _between(group: pa.Table, need: np.ndarray, exact: bool) -> list[tuple[int, int]]:
    """A forest of links between the components in two blocks (or within one).

    Links are plausible ones, or with `exact` those confirmed on the full sets.
    """
    comps = group["comp"].to_pylist()
    second = np.asarray(group["second"].to_numpy())
    marks = _signatures(group["signature"])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"].to_pylist()] if exact else []
    crossing = bool(second.any())
    forest, found = _Forest(), []
    codes = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    own = np.array([codes[c] for c in comps])
    names = list(codes)
    if len(names) < 2:
        return found
    for i in range(len(comps)):
        if crossing and second[i]:
            continue
        others = np.flatnonzero(second) if crossing else np.arange(i + 1, len(comps))
        others = others[own[others] != own[i]]
        if not len(others):
            continue
        for j in others[plausible(marks[others], marks[i : i + 1], need)].tolist():
            if forest.root(comps[i]) == forest.root(comps[j]):
                continue
            if not exact or linked(sets[i], sets[j]):
                forest.join(comps[i], comps[j])
                found.append((names[own[i]], names[own[j]]))
                # components that became one need no further pairs
                roots = np.array([codes[forest.root(c)] for c in names])
                own = roots[own]
    return found


def _blockwise(keys: list[str], exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_matches()
        for group in sorted_groups(batches, keys):
            found = _between(group, need, exact)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among distinct `keys`, which are counted before they are broadcast."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the nodes in `wanted`, made again from one text of each."""
    chosen = cut(_only(nodes.select("node", "digest", "label"), wanted, "node"))
    ids = chosen.filter("label IS NOT NULL").select(F.col("label").alias("doc_id")).distinct()
    texts = _only(docs, ids, "doc_id").select("text").unionByName(docs.filter("doc_id IS NULL").select("text"))
    made = texts.mapInArrow(_with_sets, "digest binary, shingles binary")
    return made.join(chosen.select("digest", "node"), "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _pairs_with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of every node with a link to another set."""
    bands = nodes.select("node", "signature").mapInArrow(_bands, "band long, node long")
    shared = bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last")
    members = cut(bands.join(shared.select("band", "leader"), "band").filter("node <> leader"))

    pairs = cut(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    marks = cut(_only(nodes.select("node", "signature"), _ends(pairs), "node"))
    likely = cut(_pairs_with(pairs, marks, "signature").mapInArrow(_prune, "a long, b long"))
    sets = _full_sets(docs, nodes, _ends(likely))
    first = cut(components(_pairs_with(likely, sets, "shingles").mapInArrow(_confirm, "a long, b long")))

    release(docs.sparkSession)
    # buckets whose other nodes are not all in one component
    placed = members.select("band", "node").join(first, "node", "left").select("band", "node", F.coalesce("root", "node").alias("comp"))
    uneven = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    rest = placed.join(uneven.select("band", "n"), "band").withColumn("blocks", F.ceil(F.col("n") / SIGNATURE_BLOCK).cast("int"))
    rest = rest.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    rest = rest.join(marks, "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.expr("own > other").alias("second"), "comp", "signature")
    keys = ["band", "low", "high"]
    maybe = cut(rest.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blockwise(keys, False), "a long, b long").distinct())
    if maybe.isEmpty():
        return first

    release(docs.sparkSession)
    # full sets of the trees of plausible links, in blocks
    trees = cut(components(maybe).select(F.col("node").alias("comp"), F.col("root").alias("tree")))
    inside = first.select("node", F.col("root").alias("comp")).join(trees, "comp")
    alone = trees.join(first.select(F.col("node").alias("comp")), "comp", "left_anti").select("comp", F.col("comp").alias("node"), "tree")
    inside = cut(inside.select("comp", "node", "tree").unionByName(alone))
    sizes = inside.groupBy("tree", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("tree").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"))
    sizes = sizes.select(
        "tree", F.col("most.comp").alias("main"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.n")) / SET_BLOCK)).cast("int").alias("few"),
        F.ceil(F.col("most.n") / SET_BLOCK).cast("int").alias("many"),
    )
    rows = inside.join(sizes, "tree").withColumn("big", F.expr("comp = main"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(node), if(big, many, few)) AS int)"))
    # small nodes meet small blocks (kind 0) and blocks of the main component (kind 1)
    small = F.expr("transform(sequence(0, few - 1), x -> struct(0 AS kind, least(own, x) AS low, greatest(own, x) AS high, own > x AS second))")
    cross = F.expr("transform(sequence(0, many - 1), x -> struct(1 AS kind, own AS low, x AS high, false AS second))")
    large = F.expr("transform(sequence(0, few - 1), x -> struct(1 AS kind, x AS low, own AS high, true AS second))")
    rows = rows.withColumn("place", F.explode(F.when(F.col("big"), large).otherwise(F.concat(small, cross))))
    sets = _full_sets(docs, nodes, inside.select("node"))
    keys = ["tree", "kind", "low", "high"]
    rows = rows.select("node", "tree", "place.*", "comp").join(sets.join(marks, "node"), "node")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    more = cut(components(rows.mapInArrow(_blockwise(keys, True), "a long, b long")).select(F.col("node").alias("comp"), F.col("root").alias("top")))
    deeper = first.select("node", F.col("root").alias("comp")).join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("root"))
    fresh = more.join(first.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("root"))
    return deeper.unionByName(fresh)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id`, `n_shingles`, `component_id`, `kept`, one row for each row of `docs`."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = cut(docs.mapInArrow(_describe, "doc_id long, digest binary, n_shingles long, signature binary"))
    nodes = described.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("label"), F.first("signature").alias("signature"))
    # written with the numbers, so they do not change
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    rooted = nodes.select("node", "digest", "label").join(_links(docs, nodes), "node", "left").select("digest", "label", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("label").alias("component_id")), "root").select("digest", "component_id")
    out = described.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (F.col("doc_id") == component)).alias("kept")).withColumn(
        "kept", F.coalesce("kept", F.lit(False))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose document is kept, unchanged, one for each kept id.

    Rows with a null id cannot be told apart and all stay.
    """
    judged = near_duplicates(docs, id_col, text_col).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    judged = cut(judged.select(F.col("doc_id").alias(id_col), "kept", "n"))
    release(docs.sparkSession)
    # mostly few ids, so texts stay where they are; only rows of kept ids that repeat are dealt by id
    gone, again = judged.filter("NOT kept OR n > 1").select(id_col), judged.filter("kept AND n > 1").select(id_col)
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    once = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, id_col, "left_anti")
    known = _only(docs, again, id_col).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    # rows with a null id match no key and are part of `once`
    return once.select(*docs.columns).unionByName(known.select(*docs.columns))
