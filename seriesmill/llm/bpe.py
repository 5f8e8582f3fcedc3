"""Byte-level BPE with a local rank file.

`encode_decode` is the operator; ids are those of the tiktoken library for the given split
pattern without special tokens.  Long texts are cut at places where a match of the pattern
always starts: before a space between two words, and where a run of letters or digits ends.  No
call sees more than about PIECE characters unless one match is longer.  Long runs of white space
hold no such place, and the lookahead of the pattern needs a stack as deep as the run; they are
split by hand, all but the last character before another word, and encoded by the ranks alone.

Defined results: null text counts as empty (no ids, no bytes); rows with a null or repeated
id are encoded like any other; an empty table gives an empty result; only the two named
columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.shared import OUT_ROWS

#: characters of a text that are encoded in one call
PIECE = 1 << 16
#: white space characters from which a run is split by hand
LONG_RUN = 1 << 12
_SIGN = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
#: places where a match of the pattern starts: a space between two other characters, the end of a
#: run of letters or digits (only plain ones, whose class all versions of Unicode share)
_SAFE = re.compile(rf"(?<=\S) (?=\S)|(?<=[{_LETTER}])(?=[0-9{_SIGN} \t-\r])|(?<=[0-9])(?=[{_LETTER}{_SIGN} \t-\r])")
# fixed values: the characters of Unicode's White_Space
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(rf"[{_WHITE}]{{{LONG_RUN},}}")
#: how the pattern must end for its runs of white space to be split by hand
_RUN_RULE = r"|\s+(?!\S)|\s+"
_ENCODINGS: dict = {}


def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file, made once in each Python process."""
    import tiktoken

    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text that encode to the same ids as the whole."""
    low = 0
    while len(text) - low > size:
        cut = _SAFE.search(text, low + size)
        if cut is None:
            break
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:]


def runs_apart(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of a text that encode to the same ids as the whole; true if it is one match of white space."""
    low = 0
    for m in _RUN.finditer(text):
        # the last character goes with the word that follows
        end = m.end() - (m.end() < len(text))
        if low < m.start():
            yield False, text[low : m.start()]
        yield True, text[m.start() : end]
        low = end
    if low < len(text):
        yield False, text[low:]


def encode_text(own, text: str, whole=None) -> list[int]:
    """Ids of a text; `whole` encodes a text as one match, if runs of white space may be split."""
    if len(text) <= PIECE:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for one_match, part in runs_apart(text) if whole else [(False, text)]:
        if one_match:
            ids += whole.encode_ordinary(part)
            continue
        for piece in pieces(part):
            ids += own.encode_ordinary(piece)
    return ids


def _public(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_decode(
    docs: DataFrame,
    rank_file: str | None = None,
    pattern: str | None = None,
    tokenizer: str = "byte_bpe_multi_50k.tiktoken",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns `doc_id`, `ids` array<int> and `decoded` binary, the bytes of these ids.

    `rank_file` and `pattern` name any local ranks; without them each executor takes the
    installed public file `tokenizer`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        default = _public(tokenizer) if rank_file is None or pattern is None else ("", "")
        ranks, split = rank_file or default[0], pattern or default[1]
        own = encoding(ranks, split)
        whole = encoding(ranks, r"(?s:.+)") if split.endswith(_RUN_RULE) else None
        for batch in batches:
            for low in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(low, OUT_ROWS)
                ids = [encode_text(own, text or "", whole) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode_bytes(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )
