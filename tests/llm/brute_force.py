"""Plain versions of the operators, row by row, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORDS = re.compile("[^\x20\x09-\x0d]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    key = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for k, (kind, pattern, group, least) in enumerate(
        [("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    ):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [(s, k, x) for s, k, x in sorted(found)]


def secrets_row(text: str | None) -> tuple:
    spans = secret_spans(text or "")
    kinds = Counter(x.split(":")[0] for _, _, x in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(x for _, _, x in spans))


def quality_row(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    at: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), for distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    shared: Counter = Counter()
    for i in sets:
        own = Counter(j for x in sets[i] for j in holders[x] if j > i)
        for j, both in own.items():
            shared[i, j] = both
    for (i, j), both in shared.items():
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats_removed(docs: list[tuple[int, str | None]], k: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, removed words, digest of the kept ones), for distinct ids."""
    words = {i: WORDS.findall(t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, own in words.items():
        gone = {p + j for p in range(len(own) - k + 1) if first[tuple(own[p : p + k])] < i for j in range(k)}
        out[i] = len(own), len(gone), sha(" ".join(w for p, w in enumerate(own) if p not in gone))
    return out
