"""Secret scans with a trigram index.

Every rule is a regular expression.  From its parse tree follow strings that each match must
hold, and from these a Boolean query over trigrams (alternatives of conjunctions).  Each run of
texts gets an inverted index of the trigrams that the queries use, on letters folded to lower
case; postings are intersected and united, and only the texts found are read by the rule.  Rules
without a mandatory trigram read every text.  The index is split by documents, so a trigram
that occurs in every text makes no group of its own.

Defined results: null and empty texts have no spans; spans are in code points with the end
exclusive; a rule keeps leftmost non-overlapping matches, then drops those that are too short;
spans of different rules may overlap; rows with null or repeated ids are scanned like others;
only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import text as words_of

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the three base rules as specified, then common credential formats
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # the runs [0-9a-f]+ of 16 characters or more
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# a line break, also as written in a string literal
_BREAK = r"(?:\r?\n|\r|\\r\\n|\\n)"
# what may stand before and after the key characters of a line: comment marks, quotes, joiners
_LEAD = r"""[^\S\r\n]*(?:(?:[#*>|"']|//)[^\S\r\n]*)*"""
_TAIL = r"""(?:[^\S\r\n]|["'+,;])*(?:\\(?=[\r\n]))?"""
_LINE_END = rf"(?={_BREAK}|-----|\Z)"
# key lines after a first line without its last one: fields, empty lines and base64 to the end of
# the line; long runs of base64 may also share a line
_KEY_TEXT = (
    rf"(?:[^\S\r\n]*[A-Za-z0-9+/]{{16,}}=*|{_TAIL}{_BREAK}{_LEAD}"
    rf"(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*|[A-Za-z0-9+/]*=*(?:[A-Za-z0-9+/]{{4}})?(?={_TAIL}{_LINE_END})))*"
)
MORE_RULES = (
    # up to the last line, if it comes before another first line
    Rule("pem", rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*-----|{_KEY_TEXT})"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloudkey", r"AIza[A-Za-z0-9_-]{35,}"),
    # a password may hold : and @, it ends at the last @ before the path
    Rule("url", r"""(?:https?|ftp|postgres|postgresql|mysql|redis|mongodb|amqp)://[^\s/:@]+:[^\s/@]+@(?:[^\s/@"'<>]*@)*"""),
)
RULES = BASE_RULES + MORE_RULES
#: alternatives that are kept for one stretch of a pattern
MOST_STRINGS = 64
INDEX_TEXTS = 1024


def _strings(node) -> set[str] | None:
    """All strings that one parsed item can match, if few; letters folded."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN":
        found: set[str] = set()
        for kind, what in value:
            if str(kind) != "LITERAL":
                return None
            found.add(chr(what).lower())
        return found if len(found) <= MOST_STRINGS else None
    if op == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if op == "BRANCH":
        found = set()
        for way in value[1]:
            own = _sequence_strings(way)
            if own is None:
                return None
            found |= own
        return found
    if op == "MAX_REPEAT":
        low, high, inner = value
        own = _sequence_strings(inner)
        if own is None or (low, high) not in ((0, 1), (1, 1)):
            return None
        return own | ({""} if low == 0 else set())
    if op == "AT":
        return {""}
    return None


def _sequence_strings(items) -> set[str] | None:
    made = {""}
    for item in items:
        own = _strings(item)
        if own is None or len(made) * len(own) > MOST_STRINGS:
            return None
        made = {a + b for a, b in product(made, own)}
    return made


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]] | None:
    """Clauses that all must hold; a clause is a list of alternative trigram sets.

    None if no trigram is mandatory.
    """
    clauses: list[list[frozenset[bytes]]] = []

    def close(strings: set[str]) -> None:
        if all(len(s.encode()) >= 3 for s in strings):
            sets = {frozenset(raw[i : i + 3] for i in range(len(raw) - 2)) for raw in map(str.encode, strings)}
            # an alternative that holds another one adds nothing
            clauses.append(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))

    def walk(items) -> None:
        made = {""}
        for item in items:
            own = _strings(item)
            if own is not None and len(made) * len(own) <= MOST_STRINGS:
                made = {a + b for a, b in product(made, own)}
                continue
            close(made)
            made = {""}
            if str(item[0]) == "SUBPATTERN":
                walk(item[1][-1])
        close(made)

    walk(_sre.parse(pattern))
    return clauses or None


class TrigramIndex:
    """Postings of chosen trigrams over a run of texts."""

    def __init__(self, trigrams: list[bytes]):
        self.slots = {t: i for i, t in enumerate(trigrams)}
        self.lookup = np.full(1 << 24, -1, dtype=np.int16)
        for t, i in self.slots.items():
            self.lookup[(t[0] << 16) | (t[1] << 8) | t[2]] = i
        self.postings: list[np.ndarray] = []

    def build(self, texts: pa.Array) -> None:
        found: list[list[np.ndarray]] = [[] for _ in self.slots]
        for block in words_of.blocks(texts, lower=True):
            raw = block.data.copy()
            capital = (raw >= 65) & (raw <= 90)
            raw[capital] += 32
            if len(raw) < 3:
                continue
            wide = raw.astype(np.int32)
            slot = self.lookup[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
            at = np.flatnonzero(slot >= 0)
            owner = np.searchsorted(block.bounds, at, side="right") - 1
            at_slot = slot[at]
            pairs = np.unique(at_slot.astype(np.int64) * block.n + owner)
            for i in np.unique(pairs // block.n):
                found[i].append(pairs[pairs // block.n == i] % block.n + block.first)
        self.postings = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in found]

    def search(self, query: list[list[frozenset[bytes]]]) -> np.ndarray:
        """Texts that satisfy the query, in order."""
        result: np.ndarray | None = None
        for alternatives in query:
            either = np.empty(0, dtype=np.int64)
            for trigrams in alternatives:
                both: np.ndarray | None = None
                for t in trigrams:
                    own = self.postings[self.slots[t]]
                    both = own if both is None else np.intersect1d(both, own, assume_unique=True)
                either = np.union1d(either, both)
            result = either if result is None else np.intersect1d(result, either, assume_unique=True)
        return result


def rule_spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    compiled = [re.compile(rule.pattern, re.ASCII) for rule in rules]
    queries = [trigram_query(rule.pattern) for rule in rules]
    trigrams = sorted({t for q in queries if q for clause in q for alternative in clause for t in alternative})
    return compiled, queries, trigrams


def scan_batch(texts: pa.Array, rules: tuple[Rule, ...], index: TrigramIndex, compiled: list[re.Pattern], queries: list) -> list[list[tuple]]:
    """Spans (kind, start, end) of each text, by start and then in the order of the rules."""
    index.build(texts)
    plain = texts.to_pylist()
    found: list[list[tuple]] = [[] for _ in plain]
    for order, (rule, pattern, query) in enumerate(zip(rules, compiled, queries, strict=True)):
        for i in range(len(plain)) if query is None else index.search(query).tolist():
            if plain[i]:
                found[i] += [(start, order, end) for start, end in rule_spans(rule, pattern, plain[i])]
    return [[(rules[order].kind, start, end) for start, order, end in sorted(spans)] for spans in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id` and `spans`, array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, queries, trigrams = _scanner(rules)
        index = TrigramIndex(trigrams)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, INDEX_TEXTS):
                part = batch.slice(low, INDEX_TEXTS)
                spans = scan_batch(part["text"], rules, index, compiled, queries)
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )


def merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """Union of spans that are sorted by start."""
    out: list[list[int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span of `text_col` replaced by `mark`.

    Where spans touch or overlap, their union gets one mark.  `length_col` is set to the new
    length of texts that changed.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, queries, trigrams = _scanner(rules)
        index = TrigramIndex(trigrams)
        for batch in batches:
            for low in range(0, batch.num_rows, INDEX_TEXTS):
                part = batch.slice(low, INDEX_TEXTS)
                column = part[text_col]
                plain = column.to_pylist()
                lengths = part[length_col].to_pylist() if length_col in names else None
                for i, spans in enumerate(scan_batch(column, rules, index, compiled, queries)):
                    if not spans:
                        continue
                    text, pieces, last = plain[i], [], 0
                    for start, end in merged(spans):
                        pieces += [text[last:start], mark]
                        last = end
                    plain[i] = "".join([*pieces, text[last:]])
                    if lengths is not None:
                        lengths[i] = len(plain[i])
                arrays = []
                for name in names:
                    own = part[name]
                    if name == text_col:
                        own = pa.array(plain, own.type)
                    elif name == length_col:
                        own = pa.array(lengths, own.type)
                    arrays.append(own)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema)
