"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.shared import cut, release

#: edges that one task writes at least; each task of a shuffle is a file of its own
TASK_EDGES = 250_000


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Columns `node`, `root` for every end of an edge in columns `a`, `b`.

    The root is the least node of its component.  Two star steps alternate: larger neighbours
    are tied to the least neighbour of a node, then smaller ones.  Edges never grow in number,
    the rounds grow with the logarithm of the longest path, and each round is written to the
    shared folder.  Tasks are as many as the edges need, so small graphs leave few files.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    before = _print(edges)
    while before[0]:
        tasks = 1 + before[0] // TASK_EDGES
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        after = _print(edges)
        both = least = large = small = None
        release(edges.sparkSession)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
