"""Exact top-k inner products with norm buckets.

Vectors are rounded down to 1/256 and grouped by length: classes of five per cent, dealt into
buckets.  Each query first meets the `SEEDS` longest vectors, a table of fixed size, which gives
a score it must reach.  It is sent only to buckets whose longest vector can reach it.  There the
score and the longest vector give a local cosine threshold.  A high threshold prunes by
coordinates: a vector at that angle or less has its largest coordinates in an interval round
those of the query.  A low one prunes by length.  What is left is verified by exact integer
products.  Nothing is lost: every bound is an upper bound, and the best k of every bucket go on.

The number of buckets is fixed (`BUCKETS`) until a bucket would hold more than `MOST` vectors,
so queries, a fiftieth of all vectors, are copied a fixed number of times.

Defined results: vectors that are null, hold null or a non-finite component, or have a null id take
no part; rows of the same id count as one, the one of the least vector; missing components of
shorter vectors are zero; equal scores go to the smaller id; components must stay below 2**26 in
size after scaling and 2**9 components, so that sums fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.shared import runs

SCALE = 256
SEEDS = 2048
BUCKETS = 128
LEAST, MOST = 64, 1 << 16
CLASS_STEP = 0.05
#: cosine threshold from which coordinates prune better than lengths
COORDINATE_FROM = 0.3
FOCUS = 4
NONE = np.iinfo(np.int64).min
SLACK = 1e-9


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id`, `v` array<bigint>, `length`: one row for each id with a usable vector."""
    raw = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(raw, lambda x: F.floor(SCALE * x.cast("double")))
    one = table.filter(usable).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    return one.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros."""
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(counts.max(initial=0)))
    out = np.zeros((len(counts), width), dtype=np.int64)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are used where they are exact."""
    width = min(vectors.shape[1], len(query))
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(width, 1) < 2**52:
        return (vectors[:, :width].astype(np.float64) @ query[:width].astype(np.float64)).astype(np.int64)
    return vectors[:, :width] @ query[:width]


class Bucket:
    """Vectors of one bucket, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.units = np.ascontiguousarray((self.vectors / np.maximum(self.lengths, 1e-300)[:, None]).T)

    def candidates(self, query: np.ndarray, length: float, least: int) -> np.ndarray:
        """Vectors whose product with the query may be `least` or more."""
        if least <= 0 or length == 0 or not len(self.ids) or self.lengths[0] == 0:
            return np.arange(len(self.ids))
        threshold = least / (length * self.lengths[0]) * (1 - SLACK)
        if threshold > 1:
            return np.empty(0, dtype=np.int64)
        # lengths prune in any case, they are sorted
        far = int(np.searchsorted(-self.lengths, -(least / length) * (1 - SLACK), side="right"))
        if threshold < COORDINATE_FROM:
            return np.arange(far)
        unit = query / length
        turn = np.arccos(threshold)
        alive = np.ones(far, dtype=bool)
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            if f >= len(self.units):
                continue
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(angle + turn, np.pi)) - SLACK
            high = np.cos(max(angle - turn, 0.0)) + SLACK
            alive &= (self.units[f, :far] >= low) & (self.units[f, :far] <= high)
        return np.flatnonzero(alive)

    def best(self, own: int, query: np.ndarray, length: float, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most k vectors other than the query itself, best first."""
        at = self.candidates(query, length, least)
        at = at[self.ids[at] != own]
        scores = products(self.vectors[at], query)
        ids = self.ids[at]
        if least != NONE:
            good = scores >= least
            ids, scores = ids[good], scores[good]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _send(seeds: Bucket, classes: list[tuple[int, float, int, int]], k: int):
    """Queries with the score they must reach, one row for each bucket that can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = np.repeat([c[1] for c in classes], [c[2] for c in classes])
        first = np.concatenate([np.arange(c[3], c[3] + c[2]) for c in classes])
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, ids, lengths = _matrix(batch["v"]), batch["id"].to_numpy(), batch["length"].to_numpy()
            rows, buckets, least = [], [], []
            for i in range(len(ids)):
                _, scores = seeds.best(int(ids[i]), vectors[i], float(lengths[i]), NONE, k)
                bound = int(scores[-1]) if len(scores) == k else NONE
                able = first if bound <= 0 else first[longest * lengths[i] * (1 + SLACK) >= bound]
                rows.append(np.full(len(able), i))
                buckets.append(able)
                least.append(np.full(len(able), bound, dtype=np.int64))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(buckets).astype(np.int64)), pa.array(np.ones(len(row), dtype=np.int32)), batch["id"].take(row),
                    batch["length"].take(row), pa.array(np.concatenate(least)), batch["v"].take(row),
                ],
                names=["bucket", "kind", "id", "length", "least", "v"],
            )

    return run


def _search(k: int):
    """Rows sorted by bucket and kind: the vectors of a bucket, then its queries in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, [], None
        for batch in batches:
            buckets, kinds = batch["bucket"].to_numpy(), batch["kind"].to_numpy()
            for low, high in runs([buckets, kinds]):
                part = batch.slice(low, high - low)
                if buckets[low] != current:
                    current, held, ready = buckets[low], [], None
                if kinds[low] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    width = max((int(p["v"].value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for p in held), default=0)
                    parts = [(p["id"].to_numpy(), _matrix(p["v"], width), p["length"].to_numpy()) for p in held]
                    empty = (np.empty(0, dtype=np.int64), np.empty((0, width), dtype=np.int64), np.empty(0))
                    ready, held = Bucket(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Bucket(*empty), []
                queries, ids = _matrix(part["v"]), part["id"].to_numpy()
                lengths, least = part["length"].to_numpy(), part["least"].to_numpy()
                found = [ready.best(int(ids[i]), queries[i], float(lengths[i]), int(least[i]), k) for i in range(len(ids))]
                counts = [len(x[0]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k best vectors for each row where `is_query(id)`.

    `is_query` makes a boolean column of the id column.
    """
    vectors = whole_vectors(table, id_col, vector_col)
    step = float(np.log1p(CLASS_STEP))
    vectors = vectors.withColumn("class", F.when(F.col("length") > 0, F.floor(F.log("length") / step)).otherwise(-1).cast("int"))
    # lengths of longs span at most some thousand classes
    counted = vectors.groupBy("class").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("class").collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not counted:
        return table.sparkSession.createDataFrame([], empty)
    size = min(max(sum(r["n"] for r in counted) // BUCKETS, LEAST), MOST)
    classes, first = [], 0
    for r in counted:
        classes.append((r["class"], r["longest"], -(-r["n"] // size), first))
        first += classes[-1][2]
    seeds = vectors.orderBy(F.desc("length"), "id").select("id", "v", "length").limit(SEEDS).toArrow().combine_chunks()
    seeds = Bucket(seeds["id"].to_numpy(), _matrix(seeds["v"].combine_chunks()), seeds["length"].to_numpy())
    plan = table.sparkSession.createDataFrame([(c, n, f) for c, _, n, f in classes], "class int, parts long, first long")
    # one row for each class of lengths
    placed = vectors.join(F.broadcast(plan), "class").withColumn("bucket", F.expr("first + pmod(xxhash64(id), parts)"))
    placed = placed.select("bucket", F.lit(0).alias("kind"), "id", "length", F.lit(0).cast("long").alias("least"), "v")
    schema = "bucket long, kind int, id long, length double, least long, v array<bigint>"
    sent = vectors.filter(is_query(F.col("id"))).select("id", "v", "length").mapInArrow(_send(seeds, classes, k), schema)
    rows = placed.unionByName(sent).repartition("bucket").sortWithinPartitions("bucket", "kind")
    found = rows.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
