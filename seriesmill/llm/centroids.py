"""Centroid clustering with progressive search over Walsh-Hadamard coefficients.

Components become whole numbers, and a vector x of 64 of them becomes H x, H the Hadamard matrix
with rows in order of their sign changes.  H x is whole as well, and the squared length of
H x - H c is 64 times that of x - c, so sums over coefficients are exact distances.  Coefficients
are read coarse to fine, block by block.  After a block, what is left of a distance lies between
the squared difference and the squared sum of the lengths of the coefficients not yet read; a
centroid whose least possible distance is strictly above the largest possible one of another is
given up.  The others are read to the last coefficient.  Centroids are kept as transforms too:
the sum of transforms is the transform of the sum, and H H = 64.

A round is one scan: every task adds up its vectors by centroid, Spark adds up the tasks, and the
driver holds the sums of eight centroids.  Vectors are never shuffled.

Defined results: vectors that are null, have a number of components other than 64, or hold null
or a non-finite one, take no part; rows of the same id are vectors of their own, of which that of
the least vector comes first where ids are hashed; a null id has no hash and comes after all
others; with fewer vectors than centroids there are as many centroids as vectors; an empty
centroid stays where it is; a table without vectors gives no rows.  Components of 2**24 or more
after scaling are an error, since exact distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: coefficients read before each elimination
STEPS = (4, 8, 16, 32, 64)
MOST = 1 << 24
#: relative rounding of the bounds, which are floats; exact sums are not rounded
SLACK = 1e-9


def hadamard(size: int = SIZE) -> np.ndarray:
    """Rows by the number of sign changes, so coarse ones come first."""
    made = np.ones((1, 1), dtype=np.int64)
    while len(made) < size:
        made = np.block([[made, made], [made, -made]])
    return made[np.argsort((made[:, 1:] != made[:, :-1]).sum(1), kind="stable")]


def whole_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and these as whole numbers."""
    fit = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == SIZE))
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)
    good = np.isfinite(flat).all(1)
    whole = np.floor(flat[good] * scale)
    if np.abs(whole).max(initial=0) >= MOST:
        raise ValueError(f"a component is {MOST} or more after scaling by {scale}")
    return fit[good], whole


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and 64 times the squared distance, both inputs transformed."""
    n, k = len(vectors), len(centroids)
    alive = np.ones((n, k), dtype=bool)
    read = np.zeros((n, k), dtype=np.int64)
    low = 0
    for high in STEPS:
        for c in range(k):
            at = np.flatnonzero(alive[:, c])
            gap = vectors[at, low:high] - centroids[c, low:high]
            read[at, c] += (gap * gap).sum(1)
        low = high
        if high < SIZE:
            own = np.sqrt((vectors[:, high:].astype(np.float64) ** 2).sum(1))[:, None]
            theirs = np.sqrt((centroids[:, high:].astype(np.float64) ** 2).sum(1))[None, :]
            least = (read + (own - theirs) ** 2) * (1 - SLACK)
            largest = np.where(alive, (read + (own + theirs) ** 2) * (1 + SLACK), np.inf)
            alive &= least <= largest.min(1, initial=np.inf)[:, None]
    # ties go to the smaller number, which argmin meets first
    total = np.where(alive, read, np.iinfo(np.int64).max)
    best = total.argmin(1)
    return best, total[np.arange(n), best]


def _pieces(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, scale: int) -> Iterator[tuple]:
    turn = hadamard().astype(np.float64)
    for batch in batches:
        at, whole = whole_vectors(batch["v"], scale)
        if len(at):
            # whole numbers below 2**31, exact in floats
            vectors = (whole @ turn.T).astype(np.int64)
            yield batch, at, vectors, *nearest(vectors, centroids)


def _sums(centroids: np.ndarray, scale: int):
    """One row for each centroid that has vectors in this task: their number, distances and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, far, total = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, SIZE), dtype=np.int64)
        for _, _, vectors, best, distance in _pieces(batches, centroids, scale):
            count += np.bincount(best, minlength=k)
            np.add.at(far, best, distance // SIZE)
            np.add.at(total, best, vectors)
        some = np.flatnonzero(count)
        columns = [some.astype(np.int32), count[some], far[some], *total[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["cluster", "n", "far", *(f"s{j}" for j in range(SIZE))])

    return run


def _round(vectors: DataFrame, centroids: np.ndarray, scale: int) -> list:
    """Number, distances and sum of the vectors of every centroid that has some."""
    columns = ["n", "far", *(f"s{j}" for j in range(SIZE))]
    parts = vectors.mapInArrow(_sums(centroids, scale), ", ".join(["cluster int", *(f"{c} long" for c in columns)]))
    return parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in columns)).collect()


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The transformed vectors with the least hashes of `seed:id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = whole_vectors(batch["v"], scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SIZE * len(at) + 1, SIZE, dtype=np.int32)), pa.array(whole.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), lists], names=["id", "v"])

    hashed = vectors.mapInArrow(run, "id long, v array<bigint>").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    chosen = hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], dtype=np.int64).reshape(-1, SIZE) @ hadamard().T


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vec_id`, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid` for every usable vector."""
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
    turn = hadamard()
    centroids = first_centroids(vectors, k, seed, scale)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for r in _round(vectors, centroids, scale):
            total = np.array([r[f"s{j}"] for j in range(SIZE)], dtype=np.int64)
            # back from the transform, exactly, then the floor of the mean
            centroids[r["cluster"]] = turn @ ((turn.T @ total) // SIZE // r["n"])
    far = {r["cluster"]: r["far"] for r in _round(vectors, centroids, scale)}
    inertia = sum(far.values())
    plain = (centroids @ turn) // SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([far.get(c, 0) for c in range(len(centroids))], dtype=np.int64)
        for batch, at, _, best, distance in _pieces(batches, centroids, scale):
            lists = pa.array(plain.tolist(), pa.list_(pa.int64())).take(pa.array(best))
            columns = [best.astype(np.int32), distance // SIZE, own[best], np.full(len(at), inertia, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), *map(pa.array, columns), lists], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return vectors.mapInArrow(run, schema)


def digest(centroid: list[int]) -> str:
    """What `centroid_sha256` holds for a centroid."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """SQL for DuckDB with the columns of the registered query, one pair of steps for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v FROM kept QUALIFY cluster < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT n, vec_id, v, min_by(cluster, far * {k} + cluster) AS cluster, min(far) AS distance
            FROM (SELECT kept.*, cluster, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS far FROM kept, c{i})
            GROUP BY n, vec_id, v)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
                SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v
                FROM (SELECT cluster, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {SIZE + 1}) t(j) GROUP BY cluster, j)
                GROUP BY cluster) m USING (cluster))"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} USING (cluster)"""
