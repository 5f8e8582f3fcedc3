"""Personal data by bootstrapped contextual extraction.

Four rules find emails, addresses, card and phone numbers.  These are the seeds.  The words round
a seed are lexical patterns: the two words before it, and the word before with the word after.
A pattern that holds different seeds of a kind in sufficient number is a candidate.  What else
stands in the slot of a candidate, anywhere in the corpus, makes a graph of patterns and
instances.  Spark scores it in rounds: a pattern by the mean score of its distinct instances, an
instance that looks like an identifier by the patterns that hold it, seeds at 1.  Identifiers
in the slot of a pattern with high confidence are new spans, of kind `context_<kind>`.

Texts are read twice: for seeds and open identifiers with their patterns, then for the other
words in the slots of the patterns that hold both.  The second scan gets a filter of fixed size
with the number of other words that each pattern can bear, and stops at one more; what passes it is
joined with the candidates, so no pattern is lost or added however many there are.

Defined results: null and empty texts have no spans; spans are in code points with the end
exclusive; a rule keeps leftmost non-overlapping matches, then drops those that fail, without
looking inside them again; spans of different rules may overlap, new spans never overlap those of
rules; copies of a text count once, since only distinct instances count; rows with null or
repeated ids are scanned like others; only the two named columns are read.  Every rule takes time
in proportion to the length of a text, also without spaces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of
from seriesmill.llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
#: distinct seeds that a candidate pattern holds at least
LEAST_SEEDS = 3
#: confidence from which a pattern discovers identifiers
CONFIDENT = 0.8
#: instances that every pattern is thought to hold besides, at score 0
DOUBT = 0.5
ROUNDS = 3
#: slots of the filter of patterns, a fixed number; more patterns only make it less selective
FILTER_SLOTS = 1 << 20

# fixed values: the character sets and lengths of the base rules as specified
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs are taken whole: a shorter part or a later start of the same run never matches instead
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIM = "\"'`()[]{}<>,;:.!?*_|"
_EDGE = (np.uint64(0x51), np.uint64(0x52))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and a domain with a dot."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        # a later local part cannot reach over this @, nor into a match
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ips(text: str) -> list[tuple[int, int]]:
    parts = ((m, [p.lstrip("0") for p in m[0].split(".")]) for m in _IP.finditer(text))
    return [m.span() for m, own in parts if all(len(p) < 4 and int(p or 0) <= 255 for p in own)]


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start."""
    if not text:
        return []
    return [(k, s, e) for k, rule in enumerate((emails, _ips, _cards, _phones)) for s, e in rule(text)]


def _pattern(first: np.ndarray, second: np.ndarray, form: int) -> np.ndarray:
    """Hash of two words and of the form of the pattern: 0 both before, 1 before and after."""
    return words_of.mix(first * np.uint64(0x9E3779B97F4A7C15) + words_of.mix(second) + np.uint64(form + 1))


class Slots:
    """Words of a block with their neighbours and their places in code points."""

    def __init__(self, block: words_of.Block):
        self.block = block
        n = len(block.hashes)
        lead = np.zeros(len(block.data) + 1, dtype=np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
        owner = block.owners()
        base = lead[block.bounds[owner]] if n else np.empty(0, dtype=np.int64)
        self.starts, self.ends = lead[block.starts] - base, lead[block.ends] - base
        self.first, self.last = block.words[owner], block.words[owner + 1] - 1

    def before(self, at: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
        """Hash of the word k places before, or of the edge of the text."""
        spot = at - k
        return np.where(spot >= low, self.block.hashes[np.maximum(spot, 0)], _EDGE[k - 1])

    def patterns(self, at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both patterns of the slots that reach from word `at` to word `until`."""
        low, high = self.first[at], self.last[at]
        one = self.before(at, 1, low)
        after = np.where(until + 1 <= high, self.block.hashes[np.minimum(until + 1, len(self.block.hashes) - 1)], _EDGE[0])
        return _pattern(self.before(at, 2, low), one, 0), _pattern(one, after, 1)

    def of_spans(self, d: int, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each span of text d."""
        low, high = self.block.words[d], self.block.words[d + 1]
        starts = self.starts[low:high]
        first = np.searchsorted(starts, [s for _, s, _ in spans], side="right") - 1 + low
        return first, np.searchsorted(starts, [e - 1 for _, _, e in spans], side="right") - 1 + low


def _instance(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64())])
_HELD = pa.struct([("pattern", pa.int64()), ("kind", pa.int8()), ("instance", pa.int64())])
_OPEN = pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind: tinyint, start: long, end: long>>"
HELD = "array<struct<pattern: long, kind: tinyint, instance: long>>"
OPEN = "array<struct<pattern: long, instance: long, start: long, end: long>>"


def _marked(block: words_of.Block) -> np.ndarray:
    """Words with a digit or @, the only ones that are looked at as strings."""
    sign = ((block.data >= 48) & (block.data <= 57)) | (block.data == 64)
    count = np.concatenate(([0], np.cumsum(sign)))
    return count[block.ends] > count[block.starts]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the rules for each row, the patterns that hold them, and those of open identifiers."""
    for batch in batches:
        plain = batch["text"].to_pylist()
        spans = [base_spans(t) for t in plain]
        held: list[list[dict]] = [[] for _ in plain]
        open_: list[list[dict]] = [[] for _ in plain]
        for block in words_of.blocks(batch["text"], lower=True):
            marked = np.flatnonzero(_marked(block))
            if not len(marked):
                continue
            slots = Slots(block)
            free = np.ones(len(block.hashes), dtype=bool)
            owner = np.searchsorted(block.words, marked, side="right") - 1
            for d in np.unique(owner).tolist():
                i = block.first + d
                if spans[i]:
                    first, last = slots.of_spans(d, spans[i])
                    for low, high in zip(first.tolist(), last.tolist(), strict=True):
                        free[low : high + 1] = False
                    instances = [_instance(plain[i][s:e]) for _, s, e in spans[i]]
                    for side in slots.patterns(first, last):
                        held[i] += [
                            {"pattern": p, "kind": k, "instance": x} for p, (k, _, _), x in zip(side.view(np.int64).tolist(), spans[i], instances, strict=True)
                        ]
            owner, marked = owner[free[marked]], marked[free[marked]]
            sides = [side.view(np.int64).tolist() for side in slots.patterns(marked, marked)]
            for j, (w, d) in enumerate(zip(marked.tolist(), owner.tolist(), strict=True)):
                i = block.first + d
                raw = plain[i][slots.starts[w] : slots.ends[w]]
                word = raw.strip(_TRIM)
                if looks_like_identifier(word):
                    start = int(slots.starts[w]) + len(raw) - len(raw.lstrip(_TRIM))
                    open_[i] += [{"pattern": side[j], "instance": _instance(word), "start": start, "end": start + len(word)} for side in sides]
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans]
        columns = [batch["k1"], batch["k2"], batch["doc_id"], pa.array(rows, pa.list_(_SPAN)), pa.array(held, pa.list_(_HELD)), pa.array(open_, pa.list_(_OPEN))]
        yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "spans", "held", "open"])


def _slot(patterns: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return (patterns & np.uint64(len(limits) - 1)).astype(np.int64)


def _limits(asked: DataFrame) -> np.ndarray:
    """For each slot of a filter of fixed size, the largest `most` of its patterns, or -1."""
    top = asked.groupBy(F.col("pattern").bitwiseAND(FILTER_SLOTS - 1).alias("slot")).agg(F.max("most").alias("most"))
    held = top.toArrow()
    made = np.full(FILTER_SLOTS, -1, dtype=np.int32)
    made[held["slot"].to_numpy()] = np.minimum(held["most"].to_numpy(), np.iinfo(np.int32).max - 1)
    return made


def looks_like_identifier(word: str) -> bool:
    """At least four characters with a digit, or an @ between others."""
    return len(word) >= 4 and (_DIGIT.search(word) is not None or "@" in word[1:-1])


def _fills(limits):
    """Other words in the slots of patterns of the filter, as distinct (pattern, word) of a task.

    Words of spans and identifiers are left out; they are known from the first scan.  Once a task
    has found more words than a pattern may hold, that pattern is done for and no more are needed.
    """
    most = limits.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[int]] = {}
        done = np.empty(0, dtype=np.uint64)
        for batch in batches:
            plain = None
            for block in words_of.blocks(batch["text"], lower=True):
                at = np.arange(len(block.hashes))
                if not len(at):
                    continue
                slots = Slots(block)
                sides = slots.patterns(at, at)
                ok = [most[_slot(side, most)] >= 0 for side in sides]
                for side, fits in zip(sides, ok, strict=True):
                    some = np.flatnonzero(fits)
                    if len(some) and len(done):
                        place = np.minimum(np.searchsorted(done, side[some]), len(done) - 1)
                        fits[some[done[place] == side[some]]] = False
                near = np.flatnonzero(ok[0] | ok[1])
                if not len(near):
                    continue
                plain = plain if plain is not None else batch["text"].to_pylist()
                owner = np.searchsorted(block.words, near, side="right") - 1
                free, marked = np.ones(len(at), dtype=bool), _marked(block)
                for d in np.unique(owner[marked[near]]).tolist():
                    for first, last in zip(*slots.of_spans(d, base_spans(plain[block.first + d])), strict=True):
                        free[first : last + 1] = False
                for w, d in zip(near[marked[near]].tolist(), owner[marked[near]].tolist(), strict=True):
                    if free[w] and looks_like_identifier(plain[block.first + d][slots.starts[w] : slots.ends[w]].strip(_TRIM)):
                        free[w] = False
                near = near[free[near]]
                out: tuple[list[int], list[int]] = ([], [])
                over = []
                for side, fits in zip(sides, ok, strict=True):
                    own = near[fits[near]]
                    limit = most[_slot(side[own], most)].tolist()
                    for p, x, top in zip(side[own].tolist(), block.hashes[own].tolist(), limit, strict=True):
                        words = found.setdefault(p, set())
                        if len(words) <= top and x not in words:
                            words.add(x)
                            out[0].append(p)
                            out[1].append(x)
                            if len(words) > top:
                                over.append(p)
                if over:
                    done = np.union1d(done, np.array(over, dtype=np.uint64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in out], names=["pattern", "instance"])

    return run


def scores(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`pattern`, `kind`, `confidence` from edges `pattern`, `kind`, `instance`, `shaped`, `seed`.

    Every edge occurs once.  For a pattern, an instance counts as sure as the other patterns that
    hold it make it, 1 - product of (1 - confidence), so no pattern confirms itself; seeds count 1
    and words that are no identifiers 0.
    """
    known = graph.groupBy("pattern", "kind").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n"))
    found = known.select("pattern", "kind", (F.col("seeds") / (F.col("n") + DOUBT)).alias("confidence"))
    open_edges = graph.filter("shaped AND seed = 0").select("pattern", "kind", "instance")
    for _ in range(rounds - 1):
        found = cut(found)
        weighed = open_edges.join(found, ["pattern", "kind"]).withColumn("doubt", F.log1p(-F.least("confidence", F.lit(0.999))))
        all_doubt = weighed.groupBy("instance", "kind").agg(F.sum("doubt").alias("all_doubt"))
        gained = weighed.join(all_doubt, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(1 - F.exp(F.col("all_doubt") - F.col("doubt"))).alias("gained"))
        score = (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + DOUBT)
        found = known.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", score.alias("confidence"))
    return found


def _candidates(held: DataFrame, identifiers: DataFrame, least_seeds: int, confident: float) -> DataFrame:
    """Patterns with sufficient seeds and an open identifier: `pattern`, `rooms`, `most`.

    `rooms` has for each kind the number of other words, which never count, beside which the
    pattern would be confident if all its identifiers were sure; null for kinds it has too few
    seeds of.  `most` is the largest.  A pattern without an open identifier discovers nothing and
    confirms nothing.  Common words are counted by pattern, since their number grows faster than the corpus.
    """
    seeds = held.groupBy("pattern").agg(*(F.count_if(F.col("kind") == k).alias(f"seeds_{k}") for k in range(len(KINDS))), F.lit(0).cast("long").alias("open"))
    unknown = identifiers.groupBy("pattern").agg(*(F.lit(0).cast("long").alias(c) for c in seeds.columns[1:-1]), F.count("*").alias("open"))
    counts = seeds.unionByName(unknown).groupBy("pattern").agg(*(F.sum(c).alias(c) for c in seeds.columns[1:]))
    sure = [F.col(f"seeds_{k}") + F.col("open") for k in range(len(KINDS))]
    rooms = [F.when(F.col(f"seeds_{k}") >= least_seeds, F.floor(F.round(sure[k] / confident - sure[k] - DOUBT, 6))) for k in range(len(KINDS))]
    return cut(counts.filter("open > 0").select("pattern", F.array(*rooms).alias("rooms"), F.array_max(F.array(*rooms)).alias("most")).filter("most >= 0"))


def _able(asked: DataFrame, others: DataFrame) -> DataFrame:
    """(pattern, kind) that may still become confident beside the other words found."""
    plain = others.groupBy("pattern").agg(F.count("*").alias("plain"))
    kept = asked.join(plain, "pattern", "left").withColumn("plain", F.coalesce("plain", F.lit(0)))
    kinds = kept.select("pattern", "plain", F.posexplode("rooms").alias("kind", "room"))
    return cut(kinds.filter("plain <= room").select("pattern", F.col("kind").cast("tinyint").alias("kind")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident, body = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(ident, body).alias("k1"), F.xxhash64(F.lit("row"), body, ident).alias("k2"), ident.alias("doc_id"), body.alias("text"))


def find_personal(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS
) -> DataFrame:
    """Columns `doc_id` and `spans`, array of (kind, start, end): first the base kinds as listed, then new ones."""
    keyed = _keyed(docs, id_col, text_col)
    seeds = cut(keyed.mapInArrow(_seeds, f"k1 long, k2 long, doc_id long, spans {SPANS}, held {HELD}, open {OPEN}"))
    held = seeds.filter("size(held) > 0").select(F.explode("held").alias("h")).select("h.*").distinct()
    open_places = seeds.filter("size(open) > 0").select("k1", "k2", F.explode("open").alias("o")).select("k1", "k2", "o.*")
    identifiers = open_places.select("pattern", "instance").distinct()
    asked = _candidates(held, identifiers, least_seeds, confident)
    limits = docs.sparkSession.sparkContext.broadcast(_limits(asked))
    others = cut(keyed.select("text").mapInArrow(_fills(limits), "pattern long, instance long").distinct())
    able = _able(asked, others)
    words = others.withColumn("shaped", F.lit(False)).unionByName(identifiers.withColumn("shaped", F.lit(True)))
    edges = (
        words.join(able, "pattern").withColumn("seed", F.lit(0))
        .unionByName(held.join(able, ["pattern", "kind"]).select("pattern", "kind", "instance", F.lit(False).alias("shaped"), F.lit(1).alias("seed")))
    )
    # a seed that also occurs as a word, or as one of another kind, stays a seed of its kind
    edges = cut(edges.groupBy("pattern", "kind", "instance").agg(F.max("shaped").alias("shaped"), F.max("seed").alias("seed")))
    sure = scores(edges, rounds).filter(F.col("confidence") >= confident).select("pattern", "kind")
    extra = (
        open_places.join(sure, "pattern").select("k1", "k2", (F.col("kind") + len(KINDS)).cast("tinyint").alias("kind"), "start", "end").distinct()
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))
    )
    whole = F.concat("spans", F.coalesce("extra", F.expr(f"CAST(array() AS {SPANS})")))
    names = F.array(*map(F.lit, (*KINDS, *(f"context_{k}" for k in KINDS))))
    named = F.transform(whole, lambda x: F.struct(F.element_at(names, x["kind"].cast("int") + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return seeds.select("k1", "k2", "doc_id", "spans").join(extra, ["k1", "k2"], "left").select("doc_id", named.alias("spans"))
