"""Prefix trie of conversations, totals of subtrees by time-forward processing.

Turns are numbered and hashed cumulatively by range pieces, so that a conversation may hold any
share of all rows: the node of a prefix is the exclusive or of 128-bit hashes of its turns, each
with its place.  Texts are hashed first and never shuffled.

A subtree total is the own value of a node and the totals of its children.  Nodes are sorted in
reverse level order by Spark's external sort; a node takes the messages that wait for it in a
priority queue, adds them up and sends the total to its parent.  The queue keeps the nearest
messages in memory and spills the others to sorted runs.  The trie is cut into shards first:
*light* nodes, with few turns below them, belong to the shard of their topmost light ancestor,
*heavy* ones to that of their ancestor at the last multiple of `BAND` levels.  Light shards run
first; what their roots send is added up by Spark per heavy parent, so a parent of millions of
children gets one message.  The heavy shards form a small tree of their own, which one more run
goes through from its leaves; then each heavy shard is run with the totals of those below it.

A node with more than max(`LEAST_LIGHT`, square root of all turns) turns below it is heavy, so
light shards are at most that large and, at each depth, there are at most as many heavy nodes.

Defined results: rows with a null conversation take no part; null roles and texts are empty; turns are
ordered by turn (null first), role, then hash of the text, so equal rows are turns in a row;
the remainder of a negative conversation is negative or zero; conversations that lose all turns end at the root; without conversations there are no nodes; the digest
of the conversations that end at a node reads them in order, in chunks made by the range pieces
that hold them, so one very common conversation passes one task as few long strings.  Scratch files of
a queue are unnamed and belong to one task, like those of a sort.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.prefix import running
from seriesmill.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
LEAST_LIGHT = 1024
BAND = 256
#: messages of a queue that stay in memory
QUEUE_ROWS = 1 << 17
#: sorted runs of a queue before they are merged
MOST_RUNS = 32
RUN_BLOCK = 4096
CHUNK_IDS = 4096
OUT_ROWS = 8192
NODE = ["depth", "a", "b"]
PARENT = ["up", "pa", "pb"]
SHARD = ["sd", "sa", "sb"]


class SpillingQueue:
    """Rows of six longs in order, the least first; what exceeds the memory waits in sorted runs."""

    def __init__(self, rows: int | None = None):
        self.rows = rows or QUEUE_ROWS
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs = 0

    def push(self, row: tuple) -> None:
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.rows:
            self.heap.sort()
            near = self.rows // 2
            self._run(iter(self.heap[near:]))
            del self.heap[near:]
            if len(self.heads) > MOST_RUNS:
                self._run(self._spilled())

    def _run(self, rows: Iterator[tuple]) -> None:
        file, block = tempfile.TemporaryFile(), []
        for row in rows:
            block.append(row)
            if len(block) == RUN_BLOCK:
                np.array(block, dtype=np.int64).tofile(file)
                block = []
        if block:
            np.array(block, dtype=np.int64).tofile(file)
        file.seek(0)
        self.runs += 1
        self._next(self._read(file), self.runs)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while len(block := np.fromfile(file, dtype=np.int64, count=6 * RUN_BLOCK)):
                yield from map(tuple, block.reshape(-1, 6).tolist())

    def _next(self, rows: Iterator[tuple], run: int) -> None:
        row = next(rows, None)
        if row is not None:
            heapq.heappush(self.heads, (row, run, rows))

    def _spilled(self) -> Iterator[tuple]:
        """All spilled rows in order; they leave the queue."""
        heads, self.heads = self.heads, []
        while heads:
            row, run, rows = heads[0]
            yield row
            following = next(rows, None)
            if following is None:
                heapq.heappop(heads)
            else:
                heapq.heapreplace(heads, (following, run, rows))

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove and return the rows that begin with `key`, which are the least ones."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:3] == key:
            row, run, rows = heapq.heappop(self.heads)
            yield row
            self._next(rows, run)

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


def totals(rows: Iterator[tuple], queue_rows: int | None = None) -> Iterator[tuple]:
    """(children, leaves, saved) for rows (shard, depth, a, b, pa, pb, children, leaves, saved).

    Rows come shard by shard, deepest first, then by (a, b); their last three values are what is
    known already.  A node without children is one leaf.
    """
    queue, at = SpillingQueue(queue_rows), None
    for shard, depth, a, b, pa_, pb, children, leaves, saved in rows:
        if shard != at:
            if len(queue):
                raise ValueError("messages were left at the end of a shard")
            at = shard
        for _, _, _, n, more_leaves, more_saved in queue.take((-depth, a, b)):
            children, leaves, saved = children + n, leaves + more_leaves, saved + more_saved
        leaves = leaves if children else 1
        yield children, leaves, saved
        if (depth, a, b) != shard:
            queue.push((1 - depth, pa_, pb, 1, leaves, saved))
    if len(queue):
        raise ValueError("messages were left at the end of a shard")


def _process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes with their totals; the other columns are handed on."""
    names = [*NODE, "pa", "pb", "children", "leaves", "saved"]
    pending: list[pa.RecordBatch] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            pending.append(batch)
            columns = [batch[c].to_pylist() for c in (*SHARD, *names)]
            for sd, sa, sb, *rest in zip(*columns, strict=True):
                yield ((sd, sa, sb), *rest)

    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        columns = {c: batch[c] for c in batch.schema.names}
        columns |= {c: pa.array(v, pa.int64()) for c, v in zip(names[-3:], zip(*found, strict=True), strict=True)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    found: list[tuple] = []
    for row in totals(rows()):
        found.append(row)
        if len(found) == pending[0].num_rows:
            yield finish(pending.pop(0), found)
            found = []
            while pending and not pending[0].num_rows:
                pending.pop(0)


def run_shards(nodes: DataFrame) -> DataFrame:
    """Time-forward processing of every shard by itself."""
    dealt = nodes.repartition(*SHARD).sortWithinPartitions(*SHARD, F.desc("depth"), "a", "b")
    return dealt.mapInArrow(_process, nodes.schema)


def subtree_totals(nodes: DataFrame, paths: DataFrame, least_light: int = LEAST_LIGHT, band: int = BAND) -> DataFrame:
    """`nodes` with `children`, `leaves` and `saved` of their subtrees.

    `nodes` has NODE, `pa`, `pb`, the own value `saved`, `conv_id` of one conversation that goes
    through it and `below`, the number of turns below it; `paths` has `conv_id` and NODE of every
    turn.  The root is (0, 0, 0).
    """
    n = paths.count()
    most = max(least_light, isqrt(n))
    nodes = nodes.withColumns({"children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
    heavy = cut(nodes.filter((F.col("below") > most) | (F.col("depth") == 0)))
    keys = heavy.select(*NODE)
    first = paths.join(keys, NODE, "left_anti").groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("s"))
    top = first.select("conv_id", *(F.col(f"s.{c}").alias(s) for c, s in zip(NODE, SHARD, strict=True)))
    light = cut(run_shards(nodes.join(keys, NODE, "left_anti").join(top, "conv_id")))

    sums = [F.sum(c).cast("long").alias(f"more_{c}") for c in ("children", "leaves", "saved")]

    def messages(roots: DataFrame) -> DataFrame:
        """What shard roots send, added up for each parent."""
        one = roots.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1).cast("long").alias("children"), "leaves", "saved")
        return one.groupBy(*NODE).agg(*sums)

    def with_messages(rows: DataFrame, sent: DataFrame) -> DataFrame:
        joined = rows.join(sent, NODE, "left")
        return joined.select(*(c for c in rows.columns if c not in ("children", "leaves", "saved")), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("children", "leaves", "saved")))

    is_root = (F.col("depth") == F.col("sd")) & (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))
    heavy = with_messages(heavy, messages(light.filter(is_root)))
    start = (F.col("depth") - F.col("depth") % band).alias("sd")
    starts = paths.filter(F.col("depth") % band == 0).select("conv_id", F.col("depth").alias("sd"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    deep = heavy.filter(F.col("depth") >= band).withColumn("sd", start).join(starts, ["conv_id", "sd"])
    shallow = heavy.filter(F.col("depth") < band).withColumns({c: F.lit(0).cast(t) for c, t in zip(SHARD, ("int", "long", "long"), strict=True)})
    heavy = cut(shallow.select(*light.columns).unionByName(deep.select(*light.columns)))

    # the tree of heavy shards: one row each, a level for each band
    own = heavy.groupBy(*SHARD).agg(F.sum("leaves").cast("long").alias("leaves"), F.sum("saved").cast("long").alias("saved"))
    up = heavy.select(*(F.col(c).alias(p) for c, p in zip(NODE, PARENT, strict=True)), *(F.col(c).alias(f"u{c}") for c in SHARD[1:]))
    links = heavy.filter(is_root & (F.col("depth") > 0)).withColumn("up", F.col("depth") - 1).join(up, PARENT).select(*SHARD, "usa", "usb")
    tree = own.join(links, SHARD, "left").select(
        F.lit(0).alias("sd"), F.lit(0).cast("long").alias("sa"), F.lit(0).cast("long").alias("sb"), (F.col("sd") / band).cast("int").alias("depth"), F.col("sa").alias("a"), F.col("sb").alias("b"),
        F.coalesce("usa", F.lit(0)).cast("long").alias("pa"), F.coalesce("usb", F.lit(0)).cast("long").alias("pb"), F.lit(1).cast("long").alias("children"), "leaves", "saved",
    )
    across = run_shards(tree).select((F.col("depth") * band).cast("int").alias("depth"), "a", "b", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    roots = heavy.filter(is_root & (F.col("depth") > 0)).join(across, NODE).select("depth", "pa", "pb", F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved"))
    return light.unionByName(run_shards(with_messages(heavy, messages(roots)).select(*light.columns))).drop(*SHARD)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conversation) rows of a piece as strings of at most `CHUNK_IDS` ids."""
    names = [*NODE, "piece", "part", "ids"]
    out: list[tuple] = []
    key, ids, part, piece = None, [], 0, 0
    for batch in batches:
        for *own, p, i in zip(*(batch[c].to_pylist() for c in (*NODE, "piece", "conv_id")), strict=True):
            if own != key or len(ids) == CHUNK_IDS:
                if ids:
                    out.append((*key, piece, part, ",".join(ids)))
                part = part + 1 if own == key else 0
                key, ids, piece = own, [], p
            ids.append(str(i))
        while len(out) >= OUT_ROWS:
            yield _batch(out[:OUT_ROWS], names)
            out = out[OUT_ROWS:]
    if ids:
        out.append((*key, piece, part, ",".join(ids)))
    yield _batch(out, names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*NODE, "ends_sha256"]
    key, state, out = None, None, []
    for batch in batches:
        for *own, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids")), strict=True):
            if own != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) >= OUT_ROWS:
            yield _batch(out, names)
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
    yield _batch(out, names)


_TYPES = {"depth": pa.int32(), "piece": pa.int32(), "part": pa.int32(), "ids": pa.string(), "ends_sha256": pa.string()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """NODE and `ends_sha256` of its conversations, in order, for rows (NODE, `conv_id`)."""
    pieces = ends.repartitionByRange(*NODE, "conv_id").withColumn("piece", F.spark_partition_id()).sortWithinPartitions(*NODE, "conv_id")
    chunks = pieces.mapInArrow(_chunks, "depth int, a long, b long, piece int, part int, ids string")
    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "piece", "part")
    return dealt.mapInArrow(_digests, "depth int, a long, b long, ends_sha256 string")


def rebuilt(table: DataFrame, borrowed: Callable[[Column], Column], base: Callable[[Column], Column], id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """Turns and lengths of rebuilt conversations, as two tables.

    A conversation c is rebuilt from the first `borrowed(c)` turns of `base(c)`, all if fewer,
    and from its own turns after as many of them.  Turns are (`conv_id`, `depth`, `t1`, `t2`,
    `words`), with two hashes of role and text; lengths (`conv_id`, `length`).
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = table.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("turn"), text, role).alias("t2"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    # equal rows are told apart by nothing, and need not be: any order of them is the same
    rows = running(rows.withColumn("row", F.monotonically_increasing_id()), ["conv_id"], ["turn", "role", "t1", "t2", "row"], {"pos": ("count", "t1")})
    rows = cut(rows.select("conv_id", F.col("pos").cast("int").alias("pos"), "t1", "t2", "words"))
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n_own")).withColumns({"base": base(F.col("conv_id")), "h": borrowed(F.col("conv_id")).cast("int")})
    most = F.least("h", F.coalesce("n_base", F.lit(0)))
    lengths = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    lengths = cut(lengths.select("conv_id", "base", "h", most.alias("taken"), (most + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")))
    own = rows.join(lengths, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "words")
    # only the few first turns of bases are copied
    heads = rows.withColumnRenamed("conv_id", "base").filter(F.col("pos") <= F.lit(lengths.agg(F.coalesce(F.max("taken"), F.lit(0))).first()[0]))
    head = lengths.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "words")
    return head.unionByName(own), lengths.select("conv_id", "length")


def prefix_trie(turns: DataFrame, lengths: DataFrame, least_light: int = LEAST_LIGHT, band: int = BAND) -> DataFrame:
    """The nodes: `conv_id`, `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`."""
    hashes = turns.withColumns({"x1": F.xxhash64("depth", "t1", "t2"), "x2": F.xxhash64("t2", F.lit("node"), "depth", "t1")})
    paths = running(hashes, ["conv_id"], ["depth"], {"a": ("bit_xor", "x1"), "b": ("bit_xor", "x2")})
    paths = cut(paths.join(lengths, "conv_id").select("conv_id", *NODE, F.col("a").bitwiseXOR(F.col("x1")).alias("pa"), F.col("b").bitwiseXOR(F.col("x2")).alias("pb"), "words", "length"))
    nodes = paths.groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum((F.col("length") - F.col("depth")).cast("long")).alias("below"), F.max("words").cast("long").alias("words"),
    )
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length").cast("long")).alias("below"))
    zero = {c: F.lit(0).cast(t) for c, t in (("depth", "int"), ("a", "long"), ("b", "long"), ("pa", "long"), ("pb", "long"), ("words", "long"))}
    root = whole.filter("n_convs > 0").withColumns(zero)
    nodes = nodes.unionByName(root.select(*nodes.columns)).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    done = cut(subtree_totals(cut(nodes), paths.select("conv_id", *NODE), least_light, band))

    ends = paths.filter("depth = length").select(*NODE, "conv_id").unionByName(lengths.filter("length = 0").select(zero["depth"].alias("depth"), zero["a"].alias("a"), zero["b"].alias("b"), "conv_id"))
    # the root has the most children, and its conversation is the least of all
    parents = done.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    lowest = F.lit(lengths.agg(F.min("conv_id")).first()[0]).cast("long")
    out = done.join(parents, ["depth", "pa", "pb"], "left").join(end_digests(ends), NODE, "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == 1, lowest).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(table: DataFrame, least_light: int = LEAST_LIGHT, band: int = BAND, **columns: str) -> DataFrame:
    """The trie of conversations rebuilt in groups of twenty, with up to three borrowed turns."""
    turns, lengths = rebuilt(table, lambda c: F.crc32(c.cast("string")) % 4, lambda c: c - c % 20, **columns)
    return prefix_trie(turns, lengths, least_light, band)


ORACLE = """
    WITH turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
               struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x
        FROM conversations WHERE conv_id IS NOT NULL
    ), whole AS (
        SELECT conv_id, list(x ORDER BY pos) AS own,
               -- crc32 of the decimal id: one step a bit, the byte is added before its first
               xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda s, e: xor(xor(s, e) >> 1, 3988292384 * (xor(s, e) & 1))), 4294967295::BIGINT) % 4 AS h
        FROM turns GROUP BY conv_id
    ), built AS (
        SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS path
        FROM whole c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 20
    ), steps AS (
        SELECT conv_id, d, path[1:d] AS prefix, len(path) = d AS ends FROM built, range(0, 1000) r(d) WHERE d <= len(path)
    ), nodes AS (
        SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends,
               (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix[d].t), '[^\\x20\\x09-\\x0D]+')) END AS saved
        FROM steps GROUP BY prefix, d
    ), linked AS (
        SELECT n.*, p.conv_id AS parent, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.prefix[1:n.d] = n.prefix) AS n_children
        FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
    ), ways AS (
        SELECT m.prefix[1:a] AS top, a AS d, m.saved, m.n_children FROM linked m, range(0, 1000) r(a) WHERE a <= m.d
    ), sums AS (
        SELECT top, d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM ways GROUP BY top, d
    )
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
           sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM linked n JOIN sums s ON s.top = n.prefix AND s.d = n.d
"""
