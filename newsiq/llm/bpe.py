"""Byte-level BPE as a monoid: halves are encoded alone and joined at their boundary.

A position between two characters is certain when every tokenisation of every
text with these two characters splits there: the split pattern never matches
across a change between letters, digits, other signs and a following white
space (an apostrophe before a letter excepted, and white space joins what
follows it).  Between certain positions a stretch has the same ids in any
surroundings.  Joining two encoded neighbours therefore re-encodes only the
stretch from the last certain position of the left one to the first certain
position of the right one; all ids outside stay.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from newsiq.llm.batches import buffers, held, slices, strings, with_columns

#: Characters (of a text) and ids (of a list) that are handled without halving.
LEAF_CHARS, LEAF_IDS = 256, 4096
#: First width of the window in which a certain position is looked for; it doubles.
WINDOW = 32

# Characters on whose class two Unicode versions, or two regex engines, may differ are never next to a certain position.
_UNSURE = r"[\p{Cn}\x1c-\x1f\x85᠎]"
_CERTAIN = regex.compile(
    rf"(?<!{_UNSURE})(?!{_UNSURE})(?:"
    r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])|(?<=')(?=[\s\p{N}]))"
)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 piece and its rank per line."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, data.splitlines())}


def codec(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_certain(text: str, lo: int, hi: int) -> int:
    """The last certain position inside text[lo:hi], else ``lo``; the window grows to the left."""
    width = WINDOW
    while True:
        at = max(lo, hi - width)
        found = None
        for found in _CERTAIN.finditer(text, at + 1, hi - 1):
            pass
        if found is not None:
            return found.start()
        if at == lo:
            return lo
        width *= 2


def _first_certain(text: str, lo: int, hi: int) -> int:
    """The first certain position inside text[lo:hi], else ``hi``; the window grows to the right."""
    at, width = lo, WINDOW
    while at < hi:
        found = _CERTAIN.search(text, at + 1, min(at + width, hi) - 1) if min(at + width, hi) - 1 >= at + 1 else None
        if found is not None:
            return found.start()
        at, width = at + max(1, width - 2), width * 2
    return hi


def encode_text(text: str, encode, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text`` by halving, equal to ``encode(text)``."""

    def tree(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = tree(lo, mid), tree(mid, hi)
        a, b = _last_certain(text, lo, mid), _first_certain(text, mid, hi)
        stay = len(left) - len(encode(text[a:mid]))
        return left[:stay] + encode(text[a:b]) + right[len(encode(text[mid:b])) :]

    return tree(0, len(text))


def decode_ids(ids, decode, leaf: int = LEAF_IDS) -> bytes:
    """Bytes of ``ids``: those of the halves, one after the other."""
    if len(ids) <= leaf:
        return decode(ids)
    mid = len(ids) // 2
    return decode_ids(ids[:mid], decode, leaf) + decode_ids(ids[mid:], decode, leaf)


def _codec(files, pattern: str) -> tuple:
    """(encoding call, decoding call) of a broadcast file, built once per Python worker."""

    def build() -> tuple:
        ranks = load_ranks(files.value)
        pieces = dict(zip(ranks.values(), ranks, strict=True))
        return codec(ranks, pattern).encode_ordinary, lambda ids: b"".join(map(pieces.__getitem__, ids))

    return held("bpe", (hash(files.value), pattern), build)


def _file(df: DataFrame, path: str):
    """The vocabulary file, about a megabyte and fixed, for all executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as ``out`` array<int>.

    No special tokens: their strings are ordinary text.  A null or empty text
    gives an empty array.  Rows are independent, so repeated rows give repeated
    results and an empty table an empty one.  A column of ``df`` named ``out``
    is replaced; the columns of ``df``, or of ``keep``, are returned beside it.
    """
    files = _file(df, ranks_path)

    def run(batch: pa.RecordBatch) -> list:
        return [_encoded(strings(batch, text_col), _codec(files, pattern)[0])[0]]

    return with_columns(df, f"`{out}` array<int>", run, keep, by=text_col)


def _encoded(texts: pa.Array, encode, decode=None) -> tuple[pa.Array, pa.Array | None]:
    """The ids of texts and, with ``decode``, the bytes they decode to, a slice of texts at a time."""
    parts, counts, decoded = [], [], []
    for lo, hi in slices(buffers(texts)[1]):
        rows = [encode_text(t, encode) for t in texts[lo:hi].to_pylist()]
        counts += map(len, rows)
        if decode:
            decoded.append(pa.array([decode_ids(r, decode) for r in rows], pa.binary()))
        parts += [np.array(r, np.int32) for r in rows]
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.concat_arrays(decoded) if decoded else pa.array([], pa.binary())


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``ids`` array<int> and ``decoded`` binary: :func:`encode` and :func:`decode` of its ids in one pass and one worker."""
    files = _file(df, ranks_path)

    def run(batch: pa.RecordBatch) -> list:
        return list(_encoded(strings(batch, text_col), *_codec(files, pattern)))

    return with_columns(df, "ids array<int>, decoded binary", run, keep, by=text_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes of each id list as ``out`` binary; a null list gives no bytes.

    Bytes need not be valid UTF-8, as a list may end inside a character.
    """
    files = _file(df, ranks_path)

    def run(batch: pa.RecordBatch) -> list:
        call, lists = _codec(files, pattern)[1], batch.column(batch.schema.get_field_index(ids_col))
        return [pa.array((decode_ids(x.as_py() or [], call) for x in lists), pa.binary())]

    return with_columns(df, f"`{out}` binary", run, keep)
