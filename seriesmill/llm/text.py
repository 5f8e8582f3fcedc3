"""Words of many texts at once, as arrays.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is the
same as runs of characters outside that set.  Every word gets a 64-bit hash; lower-casing A-Z
is part of the hash, so texts are never copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text that are worked on together; a longer text is a block of its own
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    if lower:
        values[65:91] = values[97:123]
    values[SPACE] = 0
    return values


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def powers(n: int, of: np.uint64 = _MULTIPLIER) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    if len(_powers.get(int(of), ())) < n:
        made = np.full(max(n, 64), of, dtype=np.uint64)
        made[0] = 1
        _powers[int(of)] = np.multiply.accumulate(made)
    return _powers[int(of)][:n]


@dataclass
class Block:
    """Words of the texts first .. first + n - 1 of an Arrow array."""

    first: int
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # n + 1 byte offsets of the texts
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray  # byte offset after each word
    hashes: np.ndarray  # of each word
    words: np.ndarray  # n + 1 word offsets of the texts

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def owners(self) -> np.ndarray:
        """The text of each word, counted from `first`."""
        return np.repeat(np.arange(self.n), np.diff(self.words))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every window of k words inside one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        owner = self.owners()
        inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return inside, window_hashes(self.hashes, k)[inside]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, order counts."""
    n = len(hashes) - k + 1
    scale = powers(k)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * scale[j]
    return mix(total)


def blocks(texts: pa.Array, lower: bool) -> Iterator[Block]:
    """The words of a string array, block by block; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(content, dtype=np.uint8) if content is not None else np.empty(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, side="left"))
        high = min(max(high, low + 1), len(texts))
        yield _block(low, content[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], _VALUES[lower])
        low = high


def _block(first: int, data: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> Block:
    n = len(data)
    solid = ~SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[bounds] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    if len(starts):
        base = starts[0]
        # spaces have value 0; a word counts up to the next start
        if n <= 2 * BLOCK_BYTES:  # powers count from the first word and are taken back at each start
            total = np.add.reduceat(values[data[base:]] * powers(n - base), starts - base) * powers(n - base, _INVERSE)[starts - base]
        else:  # of a long text from each start, so that no more of them are held than the longest word has
            place = np.arange(base, n) - np.repeat(starts, np.diff(np.append(starts, n)))
            longest = int((ends - starts).max())
            total = np.add.reduceat(values[data[base:]] * powers(longest)[np.minimum(place, longest - 1)], starts - base)
        hashes = mix(total + (ends - starts).astype(np.uint64))
    else:
        hashes = np.empty(0, dtype=np.uint64)
    return Block(first, data, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))
