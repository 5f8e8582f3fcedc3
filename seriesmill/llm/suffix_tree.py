"""Language-model scores from a probabilistic suffix tree over words.

Words are counted over all training documents; every word is a symbol of its own.  Contexts are
the last 1 .. `depth` symbols before a token, a text being preceded by one end; contexts don't
reach beyond it.  A context or a next symbol is counted if it occurs `LEAST` times, a fixed
number, so the tree grows with the corpus.  A context stays if the distribution after it diverges
from that after its suffix by more than its parameters cost (half a logarithm of its count each);
levels end where no context stays.

The distribution of a context is interpolated with that of its suffix, with one imagined count for each
counted next symbol; the mass of the others goes to the suffix, whose distribution is that of
its own longest kept suffix.  Below all contexts a word has its share; the words not seen
share what words seen once have.

A gram of d + 1 words is the next symbol of a context of depth d and itself the context of the next
token.  So the score of a text is the sum over its words of the logarithm of their share,
and over its grams of one number each: what the gram adds as a next symbol (the logarithm of the
ratio to the suffix's probability, less that of the mass left to the suffix) and as a context
(the logarithm of the mass left).  Grams are 64-bit hashes, many to a row of a table, as arrays.  One pass over the texts for
each level counts the next symbols of its contexts and looks up the grams of the level before, in one shuffle by
buckets of hashes.  A gram is counted where its suffix is, whose probability it needs; then a second shuffle takes
those that occur often enough to their contexts, which are judged.  A pass that counts and looks up grams of several words reads the
texts `SLICES` times, each time for a part of the buckets, so that only the shuffle of one part is on disk.  Grams and words with a share of `OFTEN` of all tokens or more, at most
1 / OFTEN for each length whatever the size of the corpus, are broadcast instead: hot keys are
not shuffled to be looked up.  A bitmap of fixed size keeps most grams that score nothing out of the shuffles.

Defined results: null and empty texts are one end token; a null id is never held out; equal rows
get equal results; without training tokens every score is that of a word not seen; extra columns
are not read; a long text is a block of its own, in arrays of some tens of bytes a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of
from seriesmill.llm.shared import cut, release, shared_folder, sorted_groups

#: longest context
DEPTH = 3
#: occurrences a context or a next symbol needs, at any size of the corpus
LEAST = 2
#: share of all tokens from which words and grams are broadcast; rarer ones are joined
OFTEN = 1e-6
#: bits of a bitmap, a fixed number; more keys only make it less selective
BITS = 1 << 26
#: grams that are counted together before they leave a task
HELD = 1 << 20
#: bytes of one Arrow batch that a Python function gets; its rows are arrays
BATCH_BYTES = 1 << 22
#: numbers in one array of a table
PIECE = 1 << 14
#: tokens for each bucket of contexts
BUCKET = 1 << 20
#: share of all tokens from which the grams of a context or of a suffix are spread over all buckets
HOT = 1e-3
#: parts of the buckets that are shuffled one after the other
SLICES = 2

_END = np.uint64(0x6A09E667F3BCC909)
_STEP = np.uint64(0xD1342543DE82EF95)
#: of `_STEP`, modulo 2**64
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


@dataclass
class Line:
    """The symbols of the texts of a block, one end before and one after each."""

    symbol: np.ndarray
    owner: np.ndarray  # text
    rank: np.ndarray  # place in its text, 0: the end before it
    is_end: np.ndarray  # the end after it

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For d = 1 .. longest the hash of the d symbols up to each place, and whether they are in its text."""
        gram = np.zeros(len(self.symbol), dtype=np.uint64)
        for d in range(1, longest + 1):
            before = np.zeros_like(gram)
            before[1:] = gram[:-1]
            gram = self.symbol + _STEP * before
            yield d, gram, self.rank >= d - 1


def line(block: words_of.Block) -> Line:
    sizes = np.diff(block.words) + 2
    last = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(block.n), sizes)
    rank = np.arange(len(owner)) - (last - sizes + 1)[owner]
    is_end = np.zeros(len(owner), dtype=bool)
    is_end[last] = True
    symbol = np.full(len(owner), _END, dtype=np.uint64)
    symbol[~is_end & (rank > 0)] = block.hashes
    return Line(symbol, owner, rank, is_end)


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))


@dataclass
class Index:
    """Sorted distinct keys and where each beginning of a key starts; finds many keys at once."""

    keys: np.ndarray
    first: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Index:
        bits = len(keys).bit_length() + 1
        first = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(keys, first.astype(np.int32), 64 - bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places in the keys, -1 where absent."""
        place = np.full(len(wanted), -1, dtype=np.int32)
        start = (wanted >> np.uint64(self.shift)).astype(np.int32)
        low, high = self.first[start], self.first[start + 1]
        open_ = np.flatnonzero(low < high)
        low, high, wanted = low[open_], high[open_], wanted[open_]
        while len(open_):
            hit = self.keys[low] == wanted
            place[open_[hit]] = low[hit]
            low = low + 1
            on = ~hit & (low < high)
            open_, low, high, wanted = open_[on], low[on], high[on], wanted[on]
        return place


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return words_of.mix(keys) & np.uint64(bits - 1)


@dataclass
class Arrays:
    """Rows of a table that hold arrays in columns `a`, `b`, ..., and what is made of the arrays of a row, the keys first."""

    df: DataFrame
    types: tuple[str, ...]
    pick: Callable[..., list[np.ndarray]] = lambda *columns: list(columns)

    def then(self, pick: Callable[..., list[np.ndarray]]) -> Arrays:
        before = self.pick
        return Arrays(self.df, self.types, lambda *columns: pick(*before(*columns)))

    def map(self, run: Callable[[Iterator[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        names, types, pick = "abcd"[: len(self.types)], self.types, self.pick

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(
                pick(*(np.frombuffer(batch[c][i].as_buffer(), dtype) for c, dtype in zip(names, types, strict=True)))
                for batch in batches
                for i in range(batch.num_rows)
            )

        return self.df.select(*names).mapInArrow(over, schema)

    def rows(self, *columns: tuple[str, pa.DataType]) -> DataFrame:
        """One row for each number."""
        schema = pa.schema(columns)
        types = {pa.int64(): "long", pa.float64(): "double"}

        def run(pieces: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for key, *others in pieces:
                yield _batch(schema, **{f.name: x for f, x in zip(schema, [key.view(np.int64), *others], strict=True)})

        return self.map(run, ", ".join(f"{name} {types[t]}" for name, t in columns))


def bitmap(keys: list[Arrays]) -> np.ndarray:
    """Bits set for all keys; `BITS` / 64 numbers at most reach the driver."""
    size = BITS // 64
    step = -(-size // 64)

    def run(pieces: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=np.uint64)
        for key, *_ in pieces:
            slots = _slots(key, size * 64)
            np.bitwise_or.at(bits, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        for low in range(0, size, step):
            if bits[low : low + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([bits[low : low + step].tobytes()])], names=["place", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for low, bits in zip(batch["place"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                own = np.frombuffer(bits, np.uint64)
                whole[low] = whole[low] | own if low in whole else own
        for low, bits in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([bits.tobytes()])], names=["place", "bits"])

    found = "place int, bits binary"
    rows = reduce(DataFrame.unionAll, [own.map(run, found) for own in keys]).repartition("place").mapInArrow(merged, found).toArrow()
    made = np.zeros(size, dtype=np.uint64)
    for low, bits in zip(rows["place"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        made[low : low + step] = np.frombuffer(bits, np.uint64)
    return made


def maybe(made: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are certainly not in a bitmap."""
    slots = _slots(keys, len(made) * 64)
    return (made[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


@dataclass
class Table:
    """A DataFrame written to the shared folder."""

    path: str
    df: DataFrame

    def drop(self, *kinds: int) -> None:
        """Delete the files, if kinds are given, those of these rows."""
        for path in [f"{self.path}/kind={kind}" for kind in kinds] or [self.path]:
            path = self.df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *by: str) -> Table:
    """Write `df` to the shared folder and read it again.

    The shuffle files of `df` go with the first `release` after the caller has let go of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/suffix-tree-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    release(spark)
    return Table(path, spark.read.schema(df.schema).parquet(path))


def _taken(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Pieces put together; the list is emptied."""
    whole = [np.concatenate(c) for c in zip(*pieces, strict=True)]
    pieces.clear()
    return whole


def _gathered(pieces: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Pieces put together until they hold `HELD` numbers."""
    held: list[list[np.ndarray]] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= HELD:
            yield _taken(held)
            size = 0
    if size:
        yield _taken(held)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (hashes,) in _gathered([block.hashes] for batch in batches for block in words_of.blocks(batch["text"], lower=True)):
        kinds, counts = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(counts)], names=["hash", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts as arrays."""
    for batch in _gathered([batch["hash"].to_numpy(), batch["n"].to_numpy()] for batch in batches):
        for low in range(0, len(batch[0]), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([x[low : low + PIECE].tobytes()]) for x in batch], names=["a", "b"])


def counted_words(counts: DataFrame) -> DataFrame:
    """Arrays of `hash` and `n`."""
    return counts.select("hash", "n").mapInArrow(_words, "a binary, b binary")


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(bucket[low]), low, high


@dataclass
class Look:
    """What a pass knows of the grams of one length that add to scores."""

    length: int
    index: Index  # the frequent ones
    numbers: np.ndarray  # what these add: own, for words also base and known
    rest: np.ndarray | None  # bitmap of all others that add something; None: any word may


@dataclass
class Pass:
    """What a pass over the texts counts and looks up."""

    depth: int  # of the contexts whose next symbols are counted, 0: none
    hot: Index  # grams of `depth` symbols with a large share of all tokens
    hot_totals: np.ndarray
    hot_p: np.ndarray
    hot_symbols: np.ndarray
    counted: np.ndarray | None  # bitmap of the grams of the last level
    buckets: int
    looks: list[Look]
    last: bool
    ends: int
    once: int  # words seen once
    least: int
    slices: int

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return _bucket(keys, self.buckets) % self.slices


DOC = "doc struct<doc_id long, held_out boolean, n_tokens long>"
ROWS = f"bucket int, kind int, a binary, b binary, c binary, d binary, key long, own double, base double, known double, mass double, {DOC}"
SUMS = f"key long, own double, base double, known double, copies long, {DOC}"
LEVEL = "kind int, a binary, b binary, c binary, d binary"
_DOC = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())])
_ROWS = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd"), ("key", pa.int64()), *((c, pa.float64()) for c in ("own", "base", "known", "mass")), ("doc", _DOC)]
)
_SUMS = pa.schema([("key", pa.int64()), *((c, pa.float64()) for c in ("own", "base", "known")), ("copies", pa.int64()), ("doc", _DOC)])
_LEVEL = pa.schema([("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
#: kinds of rows of a bucket.  Over texts: what grams add; suffixes; counted grams; grams of texts; sums of texts.
#: Found by these: grams for buckets of contexts; parts of the sums of hot contexts; sums for buckets of texts.
#: Contexts.  Of a level: grams, what they add as next symbols, what contexts add.
_KNOWN, _PARENT, _COUNT, _WANTED, _TEXT, _GRAM, _HOT, _SUM, _CONTEXT, _LEVEL_GRAM, _FOLLOWING, _BEFORE = range(12)


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(at: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return _batch(_ROWS, bucket=[at], kind=[kind], **{c: [x.tobytes()] for c, x in zip("abcd", arrays, strict=False)})


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (words_of.mix(keys) % np.uint64(buckets)).astype(np.int32)


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Order by bucket that leaves the rows of a bucket in theirs."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def _to_buckets(kind: int, buckets: int, part: int, slices: int):
    """Arrays for each bucket of the keys that is in a part."""

    def own(columns: list[np.ndarray]) -> list[np.ndarray]:
        if slices == 1:
            return columns
        at = _bucket(columns[0], buckets) % slices == part
        return [x[at] for x in columns]

    def run(pieces: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key, *others in _gathered(own(columns) for columns in pieces):
            bucket = _bucket(key, buckets)
            order = _by_bucket(bucket, buckets)
            key, bucket, others = key[order], bucket[order], [x[order] for x in others]
            for at, low, high in _pieces(bucket):
                piece = [x[low:high] for x in others]
                yield _packed(at, kind, key[low:high], *([np.stack(piece)] if kind == _KNOWN else piece))

    return run


def _counts(now: Pass, pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Grams of depth + 1 symbols with their suffixes, as arrays for each bucket of suffixes.

    The grams of hot suffixes are spread over all buckets.
    """
    gram, parent = _taken(pieces)
    order = np.argsort(gram)
    gram = gram[order]
    first = _heads(gram)
    n = np.diff(np.append(first, len(gram)))
    gram, parent = gram[first], parent[order[first]]
    order = np.argsort(parent)
    gram, parent, n = gram[order], parent[order], n[order].astype(np.int32)
    bucket = _bucket(np.where(now.hot.find(parent) >= 0, gram, parent), now.buckets)
    order = _by_bucket(bucket, now.buckets)
    gram, parent, bucket, n = gram[order], parent[order], bucket[order], n[order]
    for at, low, high in _pieces(bucket):
        heads = _heads(parent[low:high])
        kinds = np.diff(np.append(heads, high - low)).astype(np.int32)
        yield _packed(at, _COUNT, parent[low:high][heads], kinds, gram[low:high], n[low:high])


def _wanted(now: Pass, pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Grams to be looked up with the texts that hold them, as arrays for each bucket of grams."""
    key, text, times = _taken(pieces)
    bucket = _bucket(key, now.buckets)
    order = _by_bucket(bucket, now.buckets)
    key, text, times, bucket = (c[order] for c in (key, text, times, bucket))
    for at, low, high in _pieces(bucket):
        heads = _heads(text[low:high])
        sizes = np.diff(np.append(heads, high - low)).astype(np.int32)
        yield _packed(at, _WANTED, key[low:high], text[low:high][heads], sizes, times[low:high])


def _candidates(now: Pass, part: int, own: Line, train: np.ndarray) -> list[np.ndarray]:
    """Grams of depth + 1 symbols of the training texts of a block and their suffixes, those of a part.

    A gram that occurs often enough has a context and a gram without its oldest symbol that do.
    """
    *_, (_, shorter, _), (_, gram, inside) = own.grams(now.depth + 1)
    inside = inside & train[own.owner]
    if now.counted is not None:
        often = maybe(now.counted, shorter)
        inside &= often
        inside[1:] &= often[:-1]
    gram, parent = gram[inside], shorter[inside]
    if now.slices > 1:
        at = now.part_of(np.where(now.hot.find(parent) >= 0, gram, parent)) == part
        gram, parent = gram[at], parent[at]
    return [gram, parent]


def _looked_up(now: Pass, part: int, own: Line, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the texts of a block the sums (own, base, known) of what is broadcast; keys, texts and times of what is not.

    The sums are whole in the first part, which is the only one that needs them.
    """
    sums = np.zeros((3, n))
    add = lambda row, at, x: np.add(sums[row], np.bincount(own.owner[at], weights=x, minlength=n), out=sums[row])
    looks = {look.length: look for look in now.looks}
    words = 1 in looks and len(looks[1].numbers) == 3
    if words:  # a word that isn't found counts as not seen; the end is known
        add(0, np.flatnonzero(~own.is_end & (own.rank > 0)), None)
        sums[0] = sums[0] * np.log10(now.once) + np.log10(now.ends or 0.5)
        sums[1] += np.log10(now.ends + 1.0)
        sums[2] += now.ends > 0
    keys, owners = [], []
    for d, gram, inside in own.grams(max(looks, default=0)):
        if d not in looks:
            continue
        look = looks[d]
        at = np.flatnonzero(inside & ~own.is_end & (own.rank >= words) if d == 1 else inside)
        if part:
            at = at[now.part_of(gram[at]) == part]
        place = look.index.find(gram[at])
        found = place >= 0
        for row, x in enumerate(look.numbers):
            add(row, at[found], x[place[found]])
        at = at[~found]
        if look.rest is not None:
            at = at[maybe(look.rest, gram[at])]
        if not part and now.slices > 1:
            at = at[now.part_of(gram[at]) == 0]
        keys.append(gram[at])
        owners.append(own.owner[at])
    key, owner = np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(owners or [np.empty(0, np.int64)])
    if n == 1:  # maybe a long text that repeats itself
        key, times = np.unique(key, return_counts=True)
        return sums, [key, np.zeros(len(key), dtype=np.int64), times.astype(np.int32)]
    order = np.argsort(owner, kind="stable")
    return sums, [key[order], owner[order], np.ones(len(key), dtype=np.int32)]


def _over_texts(shared, part: int):
    """One pass over the texts: what is counted and looked up, as arrays for each bucket of a part, and in the first a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Pass = shared.value
        counts: list[list[np.ndarray]] = []
        wanted: list[list[np.ndarray]] = []
        for batch in batches:
            for block in words_of.blocks(batch["text"], lower=True):
                own, rows = line(block), batch.slice(block.first, block.n)
                held_out = rows["held_out"].to_numpy(zero_copy_only=False)
                if now.depth:
                    counts.append(_candidates(now, part, own, ~held_out))
                    if sum(len(c[0]) for c in counts) >= HELD:
                        yield from _counts(now, counts)
                if now.looks:
                    sums, (key, owner, times) = _looked_up(now, part, own, block.n)
                    texts = rows["key"].to_numpy()
                    wanted.append([key, texts[owner], times])
                    if not part:
                        more = {}
                        if now.last:
                            n_tokens = pa.array(np.bincount(own.owner, minlength=block.n) - 1)
                            more["doc"] = pa.StructArray.from_arrays([rows["doc_id"], rows["held_out"], n_tokens], fields=list(_DOC))
                        bucket = _bucket(texts.view(np.uint64), now.buckets)
                        yield _batch(_ROWS, bucket=bucket, kind=np.full(block.n, _TEXT), key=texts, own=sums[0], base=sums[1], known=sums[2], **more)
                    if sum(len(c[0]) for c in wanted) >= HELD:
                        yield from _wanted(now, wanted)
        if counts:
            yield from _counts(now, counts)
        if wanted:
            yield from _wanted(now, wanted)

    return run


def _joined(rows: pa.Table, types: dict[str, str]) -> list[np.ndarray]:
    """Binary columns of all rows as one array each."""
    return [np.frombuffer(b"".join(rows[c].to_pylist()), dtype) for c, dtype in types.items()]


def _merged(now: Pass, counts: pa.Table, parents: pa.Table) -> list[np.ndarray]:
    """Grams of a bucket that occur `least` times, their contexts, counts and the probabilities after their suffixes."""
    parent, sizes, gram, n = _joined(counts, {"a": "u8", "b": "i4", "c": "u8", "d": "i4"})
    order = np.argsort(gram)
    gram = gram[order]
    heads = _heads(gram)
    n = np.add.reduceat(n[order].astype(np.int64), heads)
    heads, n = heads[n >= now.least], n[n >= now.least]
    gram, parent = gram[heads], np.repeat(parent, sizes)[order[heads]]
    known = _joined(parents, {"a": "u8", "b": "f8", "c": "u8"})
    known, p, symbols = (np.concatenate(c) for c in zip(known, (now.hot.keys, now.hot_p, now.hot_symbols), strict=True))
    first = np.argsort(known)
    first = first[_heads(known[first])]
    place = Index.of(known[first]).find(parent)
    gram, n, at = gram[place >= 0], n[place >= 0], first[place[place >= 0]]
    # a gram is its last symbol and its context times _STEP
    return [gram, (gram - symbols[at]) * _INVERSE, n, p[at]]


def _by_context(now: Pass, pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counted grams as arrays for each bucket of contexts; those of hot contexts are spread, with their sums."""
    gram, context, n, p = _taken(pieces)
    place = now.hot.find(context)
    hot = np.flatnonzero(place >= 0)
    if len(hot):
        own_n, own_p, at = n[hot], p[hot], place[hot]
        gain = own_n * np.log(own_n / now.hot_totals[at] / own_p)
        gain, seen, kinds, mass = (np.bincount(at, weights=x, minlength=len(now.hot.keys)) for x in (gain, own_n, None, own_p))
        at = np.flatnonzero(kinds)
        yield _batch(_ROWS, kind=np.full(len(at), _HOT), key=now.hot.keys[at].view(np.int64), own=gain[at], base=seen[at], known=kinds[at].astype(float), mass=mass[at])
    bucket = _bucket(np.where(place >= 0, gram, context), now.buckets)
    order = _by_bucket(bucket, now.buckets)
    gram, context, n, p, bucket = (c[order] for c in (gram, context, n, p, bucket))
    for at, low, high in _pieces(bucket):
        yield _packed(at, _GRAM, context[low:high], gram[low:high], n[low:high], p[low:high])


def _added(known: pa.Table, wanted: pa.Table) -> Iterator[list[np.ndarray]]:
    """For each text of a bucket the sums over its grams there: texts, own, for words also base and known."""
    keys = [np.frombuffer(x, np.uint64) for x in known["a"].to_pylist()]
    pieces = [np.frombuffer(x, float).reshape(-1, len(key)) for key, x in zip(keys, known["b"].to_pylist(), strict=True)]
    numbers = np.zeros((max(map(len, pieces)), sum(map(len, keys))))
    low = 0
    for own in pieces:
        numbers[: len(own), low : low + own.shape[1]] = own
        low += own.shape[1]
    key = np.concatenate(keys)
    order = np.argsort(key)
    heads = _heads(key[order])
    index, numbers = Index.of(key[order[heads]]), np.add.reduceat(numbers[:, order], heads, axis=1)
    for asked, text, sizes, times in zip(*(wanted[c].to_pylist() for c in "abcd"), strict=True):
        text, times = np.frombuffer(text, np.int64), np.frombuffer(times, np.int32)
        owner = np.repeat(np.arange(len(text)), np.frombuffer(sizes, np.int32))
        place = index.find(np.frombuffer(asked, np.uint64))
        found = place >= 0
        owner, place, times = owner[found], place[found], times[found]
        some = np.flatnonzero(np.bincount(owner, minlength=len(text)))
        yield [text[some], *(np.bincount(owner, weights=times * x[place], minlength=len(text))[some] for x in numbers)]


def _by_text(now: Pass, pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of texts as arrays for each bucket of texts."""
    text, *sums = _taken(pieces)
    order = np.argsort(text)
    heads = _heads(text[order])
    if not len(heads):
        return
    text, sums = text[order[heads]], np.stack([np.add.reduceat(x[order], heads) for x in sums])
    bucket = _bucket(text.view(np.uint64), now.buckets)
    order = _by_bucket(bucket, now.buckets)
    text, sums, bucket = text[order], sums[:, order], bucket[order]
    for at, low, high in _pieces(bucket):
        yield _packed(at, _SUM, text[low:high], sums[:, low:high])


def _kinds(rows: pa.Table, *kinds: int) -> list[pa.Table]:
    kind = rows["kind"].to_numpy()
    return [rows.filter(pa.array(kind == k)) for k in kinds]


def _by_buckets(shared):
    """What the buckets of a sorted partition say: counted grams for buckets of contexts, and sums for those of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Pass = shared.value
        grams: list[list[np.ndarray]] = []
        sums: list[list[np.ndarray]] = []
        for rows in sorted_groups(batches, ["bucket"]):
            known, parents, counts, wanted, texts = _kinds(rows, _KNOWN, _PARENT, _COUNT, _WANTED, _TEXT)
            if texts.num_rows:
                yield from texts.combine_chunks().to_batches()
            if counts.num_rows:
                grams.append(_merged(now, counts, parents))
                if sum(len(c[0]) for c in grams) >= HELD:
                    yield from _by_context(now, grams)
            if known.num_rows and wanted.num_rows:
                for piece in _added(known, wanted):
                    sums.append(piece)
                    if sum(len(c[0]) for c in sums) >= HELD:
                        yield from _by_text(now, sums)
        if grams:
            yield from _by_context(now, grams)
        if sums:
            yield from _by_text(now, sums)

    return run


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of the buckets of a sorted partition, the sums of its rows."""
    for rows in sorted_groups(batches, ["bucket"]):
        texts, pieces = _kinds(rows, _TEXT, _SUM)
        key, first, at = np.unique(texts["key"].to_numpy(), return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(at, weights=texts[c].to_numpy(), minlength=len(key)) for c in ("own", "base", "known")])
        for text, own in zip(pieces["a"].to_pylist(), pieces["b"].to_pylist(), strict=True):
            text = np.frombuffer(text, np.int64)
            own = np.frombuffer(own, float).reshape(-1, len(text))
            sums[: len(own), np.searchsorted(key, text)] += own
        doc = texts["doc"].combine_chunks()
        copies = np.bincount(at, weights=doc.is_valid().to_numpy(zero_copy_only=False), minlength=len(key)).astype(np.int64)
        yield _batch(_SUMS, key=key, own=sums[0], base=sums[1], known=sums[2], copies=copies, doc=doc.take(pa.array(first)))


def _smoothed(total, seen, kinds, gain, mass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts stay, their counts with those imagined, and the mass left to their suffixes."""
    rest = total - seen
    others = rest * np.log(np.maximum(rest, 1) / total / np.maximum(1 - mass, 1e-12))
    kept = gain + others > 0.5 * (kinds + 1) * np.log(np.maximum(total, 2))
    scale = total + kinds
    return kept, scale, (scale - seen) / scale


@dataclass
class Hot:
    """Hot contexts, judged by the sums over all buckets."""

    index: Index
    totals: np.ndarray
    kept: np.ndarray
    scale: np.ndarray
    left: np.ndarray


def _judged(shared, final: bool):
    """Smoothing of the contexts of a bucket, which of them stay, and probabilities of their next symbols.

    Nothing follows the last level, so it holds only what is looked up.
    """

    def packed(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(columns[0]), PIECE):
            yield _batch(_LEVEL, kind=[kind], **{c: [x[low : low + PIECE].tobytes()] for c, x in zip("abcd", columns, strict=False)})

    def level(context, gram, n, p, kept, scale, left) -> Iterator[pa.RecordBatch]:
        after = np.where(kept, n / scale + left * p, p)
        if not final:
            yield from packed(_LEVEL_GRAM, gram, n, gram - _STEP * context, after)
        yield from packed(_FOLLOWING, gram[kept], n[kept], (np.log10(after / p) - np.log10(left))[kept])

    def stay(context, total, kept, left) -> Iterator[pa.RecordBatch]:
        return packed(_BEFORE, context[kept], total[kept], np.log10(left[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for rows in sorted_groups(batches, ["bucket"]):
            contexts, grams = _kinds(rows, _CONTEXT, _GRAM)
            known, totals = _joined(contexts, {"a": "u8", "b": "i8"})
            here = hot.index.find(known)
            here = here[here >= 0]
            yield from stay(hot.index.keys[here], hot.totals[here], hot.kept[here], hot.left[here])
            context, gram, n, p = _joined(grams, {"a": "u8", "b": "u8", "c": "i8", "d": "f8"})
            place = hot.index.find(context)
            at = place >= 0
            if at.any():
                yield from level(context[at], gram[at], n[at], p[at], *(x[place[at]] for x in (hot.kept, hot.scale, hot.left)))
            at = np.flatnonzero(~at)
            at = at[np.argsort(context[at])]
            if not len(at):
                continue
            context, gram, n, p = (x[at] for x in (context, gram, n, p))
            heads = _heads(context)
            kinds = np.diff(np.append(heads, len(context)))
            order = np.argsort(known)
            total = totals[order[np.searchsorted(known[order], context[heads])]]
            add = lambda x: np.add.reduceat(x, heads)  # noqa: B023, E731
            kept, scale, left = _smoothed(total, add(n), kinds, add(n * np.log(n / np.repeat(total, kinds) / p)), add(p))
            yield from stay(context[heads], total, kept, left)
            yield from level(context, gram, n, p, *(np.repeat(x, kinds) for x in (kept, scale, left)))

    return run


@dataclass
class Level:
    """Next symbols of contexts of one depth, and the contexts that stay."""

    #: arrays by kind: gram, n, symbol (the last), p; gram, n, own of those that stay, what they add
    #: as a next symbol; context, n, own: the logarithm of the mass left
    table: Table

    def _of(self, kind: int, *types: str) -> Arrays:
        return Arrays(self.table.df.filter(F.col("kind") == kind), types)

    @property
    def df(self) -> DataFrame:
        """The next symbols that are looked up."""
        return self.following().rows(("gram", pa.int64()), ("n", pa.int64()), ("own", pa.float64())).withColumn("kept", F.lit(True))

    def grams(self) -> Arrays:
        return self._of(_LEVEL_GRAM, "u8", "i8", "u8", "f8")

    def following(self) -> Arrays:
        return self._of(_FOLLOWING, "u8", "i8", "f8")

    def before(self) -> Arrays:
        return self._of(_BEFORE, "u8", "i8", "f8")


class Tree:
    """The levels of the tree, grown by passes over the texts that also add up scores.

    `texts` has `text`, for scores also `key`, `doc_id` and `held_out`; `counts` has arrays of words, their
    hashes, and their counts; `weight` is that of all words, those not seen included.
    """

    def __init__(self, texts: DataFrame, counts: DataFrame, ends: int, weight: int, once: int, scoring: bool, done: Callable[[], None] = lambda: None):
        self.done = done  # called when `counts` is read no more
        self.spark, self.counts, self.ends, self.weight, self.once, self.scoring = texts.sparkSession, counts, ends, weight, once, scoring
        self.texts = texts if scoring else texts.select("text", F.lit(False).alias("held_out"))
        self.buckets = weight // BUCKET + 1
        self.levels: list[Level] = []
        self.sums: list[DataFrame] = []

    def _words(self) -> Arrays:
        """What words add."""
        once = float(np.log10(self.once))
        return Arrays(self.counts, ("u8", "i8"), lambda k, n: [k, n, np.log10(n) - once, np.log10(n + 1.0), np.ones(len(k))])

    def _grams(self, length: int) -> list[Arrays]:
        """What grams of a length, for one word contexts only, add."""
        parts = [self.levels[length - 2].following()] if length > 1 else []
        return parts + ([self.levels[length - 1].before()] if length <= len(self.levels) else [])

    def _look(self, length: int, parts: list[Arrays], words: bool) -> tuple[Look, list[Arrays]]:
        """Those grams that are to be broadcast, and all others."""
        least = max(OFTEN * self.weight, 1)
        numbers = ["own", "base", "known"] if words else ["own"]
        columns = [("k", pa.int64()), *((c, pa.float64()) for c in numbers)]

        def often(k, n, *others):
            return [x[n >= least] for x in (k, *others)]

        def seldom(k, n, *others):
            return [x[n < least] for x in (k, *others)]

        rows = reduce(DataFrame.unionAll, [own.then(often).rows(*columns) for own in parts])
        keys, *frequent = _columns(rows.groupBy("k").agg(*(F.sum(c).alias(c) for c in numbers)), "k", *numbers)
        rest = [own.then(seldom) for own in parts]
        return Look(length, Index.of(keys), np.stack(frequent), None if words else bitmap(rest)), rest

    def _pass(self, depth: int, lengths: list[int], known: Arrays | None = None, hot: list[np.ndarray] | None = None, last: bool = False) -> Iterator[Callable[[], DataFrame]]:
        """What a pass finds, by parts, to be made one after the other; length 0: words."""
        key, totals, p, symbols = hot or [np.empty(0, dtype) for dtype in ("u8", "i8", "f8", "i8")]
        tables = [(_PARENT, known.then(lambda gram, n, symbol, p: [gram, p, symbol]))] if depth else []
        looks = []
        for length in lengths:
            look, rest = self._look(max(length, 1), self._grams(length) if length else [self._words()], not length)
            looks.append(look)
            tables += [(_KNOWN, own) for own in rest]
        # nearly all words are candidates, but few longer strings are
        counted = bitmap([known]) if depth > 1 else None
        slices = min(SLICES, self.buckets) if depth and max(lengths, default=0) > 1 else 1
        now = Pass(depth, Index.of(key), totals, p, symbols.view(np.uint64), counted, self.buckets, looks, last, self.ends, self.once, LEAST, slices)
        shared = self.spark.sparkContext.broadcast(now)
        release(self.spark)  # the shuffles of the bitmaps and of the level before

        def found(part: int) -> DataFrame:
            parts = [own.map(_to_buckets(kind, self.buckets, part, slices), ROWS) for kind, own in tables]
            rows = reduce(DataFrame.unionAll, parts, self.texts.mapInArrow(_over_texts(shared, part), ROWS))
            return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_buckets(shared), ROWS)

        return (partial(found, part) for part in range(slices))

    def _add(self, found: DataFrame) -> None:
        rows = found.filter(F.col("kind").isin(_TEXT, _SUM)).repartition("bucket").sortWithinPartitions("bucket")
        self.sums.append(cut(rows.mapInArrow(_of_texts, SUMS)))

    def _judge(self, found: DataFrame, known: Arrays, hot: list[np.ndarray], final: bool) -> Level:
        """Contexts with the grams found after them, in buckets of contexts."""
        parts = found.filter(F.col("kind") == _HOT).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("base", "known", "own", "mass")))
        key, *sums = _columns(parts, "key", "base", "known", "own", "mass")
        totals = hot[1][Index.of(hot[0]).find(key)]
        shared = self.spark.sparkContext.broadcast(Hot(Index.of(key), totals, *_smoothed(totals, *sums)))
        contexts = known.then(lambda gram, n, symbol, p: [gram, n]).map(_to_buckets(_CONTEXT, self.buckets, 0, 1), ROWS)
        rows = found.filter(F.col("kind") == _GRAM).unionAll(contexts).select("bucket", "kind", *"abcd")
        return Level(stored(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judged(shared, final), LEVEL), "kind"))

    def grow(self, depth: int) -> None:
        """Level by level: count the next symbols with their probabilities after the suffix, then judge the contexts.

        The first pass also looks up words, the one that counts level d + 1 the grams of d symbols, whose numbers are then known.
        """
        weight, least = float(self.weight), LEAST
        end = self.spark.createDataFrame([(bytearray(_END.tobytes()), bytearray(np.int64(self.ends).tobytes()))], "a binary, b binary")

        def often(k, n):
            k, n = k[n >= least], n[n >= least]
            return [k, n, k, n / weight]

        known = Arrays(self.counts.unionAll(end), ("u8", "i8"), often)
        columns = [("gram", pa.int64()), ("n", pa.int64()), ("symbol", pa.int64()), ("p", pa.float64())]
        for d in range(1, depth + 1):
            share = max(HOT * self.weight, LEAST)
            rows = known.then(lambda gram, n, symbol, p: [gram[n >= share], n[n >= share], symbol[n >= share].view(np.int64), p[n >= share]])  # noqa: B023
            hot = _columns(rows.rows(*columns), "gram", "n", "p", "symbol")
            parts = []
            for make in self._pass(d, [d - 1] if self.scoring else [], known, hot):
                parts.append(stored(make()))
                release(self.spark)
            found = reduce(DataFrame.unionAll, [part.df for part in parts])
            if self.scoring:
                self._add(found)
                if d > 2:
                    self.levels[d - 3].table.drop()
                release(self.spark)
            self.levels.append(self._judge(found, known, hot, d == depth))
            found = None
            for part in parts:
                part.drop()
            release(self.spark)
            if d == 1:
                self.done()
            elif self.scoring:  # what next symbols add is looked up by the next pass
                self.levels[d - 2].table.drop(_LEVEL_GRAM, _BEFORE)
            level = self.levels[-1]
            if level.following().df.isEmpty():
                break
            known = level.grams()

    def finish(self) -> DataFrame:
        """Look up the grams that are left; `key, own, base, known, copies, doc` of all texts."""
        d = len(self.levels)
        for make in self._pass(0, [d, d + 1] if d else [0], last=True):
            self._add(make())
            release(self.spark)
        for level in self.levels[-2:]:
            level.table.drop()
        whole = reduce(DataFrame.unionAll, self.sums).groupBy("key")
        return whole.agg(*(F.sum(c).alias(c) for c in ("own", "base", "known", "copies")), F.first("doc", ignorenulls=True).alias("doc"))


def grow(train: DataFrame, counts: DataFrame, ends: int, weight: int, depth: int) -> list[Level]:
    """The levels of the tree of all texts."""
    tree = Tree(train, counted_words(counts), ends, weight, 1, False)
    tree.grow(depth)
    return tree.levels


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded table, sorted by the first as unsigned numbers."""
    rows = df.select(*names).toArrow()
    key, *others = (rows[n].to_numpy() for n in names)
    order = np.argsort(key.view(np.uint64))
    return [key.view(np.uint64)[order], *(o[order] for o in others)]


def score(docs: DataFrame, held_out, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    `held_out` makes a boolean column of the id column; rows where it holds are not learned from.
    Scores are log10 probabilities; the base is a unigram model with one added to each count.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    number, text = F.col(id_col).cast("long"), F.col(text_col)
    base = docs.select(number.alias("doc_id"), text.alias("text"), F.coalesce(held_out(number), F.lit(False)).alias("held_out"), F.xxhash64(number, text).alias("key"))
    train = base.filter("NOT held_out").select("text")
    seen = stored(counted_words(train.mapInArrow(_unigrams, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))))
    counts = seen.df
    parts = Arrays(counts, ("u8", "i8"), lambda k, n: [np.array([x]) for x in (n.sum(), len(n), np.sum(n == 1))])
    words, kinds, once = parts.rows(*((c, pa.int64()) for c in ("words", "kinds", "once"))).agg(F.sum("words"), F.sum("kinds"), F.sum("once")).first()
    kinds, once = kinds or 0, once or 0
    ends = train.count()
    total, once = (words or 0) + ends, max(once, 1)
    weight = max(total + once, 1)
    tree = Tree(base, counts, ends, weight, once, True, seen.drop)
    if total:
        tree.grow(depth)
    # equal rows share a key, so sums over a key count them all
    found = tree.finish()
    seen.drop()
    whole = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    part = lambda c: F.col(c) / F.col("copies")
    tokens = F.col("doc.n_tokens")
    return whole.select(
        "doc.doc_id",
        "doc.held_out",
        "doc.n_tokens",
        F.round(part("known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (part("base") - tokens * F.lit(float(np.log10(total + kinds + (ends > 0) + 1)))).alias("base_score"),
        (part("own") - tokens * F.lit(float(np.log10(weight)))).alias("score"),
    )
