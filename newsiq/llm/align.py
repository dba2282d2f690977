"""Alignment of two tokenizations of the same text by interval coalescing.

All A and B tokens of a slice of texts are sorted by their start byte; the
running maximum of their ends closes a group where the next start reaches it,
and inside a group every stretch between two neighbouring starts is one pair
of overlapping tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, cut, freeing, held, slices, strings, trim

#: Texts share a block, for which distinct id pairs are listed once, up to so many bytes.
BLOCK_BYTES = 1 << 23

# Characters on whose class two Unicode versions, or two regex engines, may differ.
_UNSURE = regex.compile(r"[\p{Cn}\x1c-\x1f\x85᠎]")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in printable}
    others = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class _Pool:
    """The bytes of all tokens of a vocabulary, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        # decimal ids followed by what may come after them: nothing, the next id of the side, the other side, the next group
        self.text = np.array([f"{i}{sep}" for i in range(len(pieces)) for sep in ("", ",", "|", ";")], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.raw[np.repeat(self.start[ids] - before, size) + np.arange(int(size.sum()))]


class ByteLevel:
    """A byte-level tokenizer file; texts of unsure characters go through the tokenizers library, others through equal ranks."""

    def __init__(self, data: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec, letters = json.loads(data), _byte_letters()
        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocab = {i: t for t, i in spec["model"]["vocab"].items()}
        pieces = [bytes(letters[c] for c in vocab[i]) if i in vocab and i not in added else added.get(i, "").encode() for i in range(max([*vocab, *added]) + 1)]
        self.pool, self.ranks = _Pool(pieces), None
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
        if plain and merged == sorted(merged):  # ids in the order of the merges are ranks
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(pieces) if i not in added}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        sure = [self.ranks is not None and not _UNSURE.search(t) for t in texts]
        rest = iter(self.library.encode_batch([t for t, s in zip(texts, sure, strict=True) if not s], add_special_tokens=False))
        return [self.ranks.encode_ordinary(t) if s else next(rest).ids for t, s in zip(texts, sure, strict=True)]


class Pieces:
    """A sentencepiece model file."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.pool = _Pool([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _loaded(files, pattern: str) -> tuple[ByteLevel, Pieces]:
    return held("align", (*map(hash, files.value), pattern), lambda: (ByteLevel(files.value[0], pattern), Pieces(files.value[1])))


def coalesce(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and overlaps of two gapless sequences of intervals over the same bytes.

    Gives (order, group, link_a, link_b, link_start): the A tokens followed by
    the B tokens in order of their start, A first; the group of each in that
    order; and each overlapping pair as numbers of its A and B token with the
    byte where the overlap starts.
    """
    end = np.concatenate([np.cumsum(sizes_a), np.cumsum(sizes_b)])
    start = end - np.concatenate([sizes_a, sizes_b])
    side = np.repeat(np.array([0, 1], np.int8), [len(sizes_a), len(sizes_b)])
    order = np.lexsort((side, start))
    start, side = start[order], side[order]
    reached = np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], start[1:] >= reached[:-1]])
    last = np.concatenate([start[1:] > start[:-1], [True]])  # the last token that starts here; tokens have a byte at least
    return order, np.cumsum(opens) - 1, (np.cumsum(side == 0) - 1)[last], (np.cumsum(side == 1) - 1)[last], start[last]


def _pack(gaps: np.ndarray, times: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Two columns of numbers, byte by byte, so that the many zero bytes vanish."""
    return squeeze.compress(np.concatenate([gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel(), times.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.uint8).reshape(2, 4, -1)
    gaps, times = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in both)
    return np.cumsum(gaps), times


def _aligned(texts: pa.Array, a: ByteLevel, b: Pieces) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """([n_a, n_b, n_groups, n_links, sha256] per text, and the id pairs: text, key, times by text and key) of a slice."""
    n, rows = len(texts), texts.to_pylist()
    raw, offsets = buffers(texts)
    raw_1 = np.full(len(raw) + n, 0x20, np.uint8)  # every text with a space before it
    raw_1[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    ends = np.cumsum(np.diff(offsets) + 1)
    encoded, whole = [], np.diff(offsets) > 0
    for side, lists in ((a, a.encode([f" {t}" for t in rows])), (b, b.encode(rows))):
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        total = np.concatenate([[0], np.cumsum(side.pool.size[ids])])[at]
        same = np.diff(total) == np.diff(offsets) + 1
        joined = side.pool.joined(ids)
        if same.all():
            wrong = np.unique(np.searchsorted(ends, np.flatnonzero(joined != raw_1), "right"))
            same[wrong] = False
        else:
            for i in np.flatnonzero(same):
                same[i] = np.array_equal(joined[total[i] : total[i + 1]], raw_1[ends[i] - total[i + 1] + total[i] : ends[i]])
        whole &= same
        encoded.append((ids, at))
    out = [[0, 0, 0, 0, ""] for _ in rows]
    good = np.flatnonzero(whole)
    none = np.zeros(0, np.int64)
    if not len(good):
        return out, none, none, none
    sides = []
    for ids, at in encoded:
        ids = ids if len(good) == n else ids[np.repeat(whole, np.diff(at))]
        sides.append((ids, np.concatenate([[0], np.cumsum(np.diff(at)[good])])))
    (ids_a, at_a), (ids_b, at_b) = sides
    order, group, link_a, link_b, link_start = coalesce(a.pool.size[ids_a], b.pool.size[ids_b])
    bounds = np.concatenate([[0], np.cumsum((np.diff(offsets) + 1)[good])])
    # the digest: by group, A ids, then B ids
    side = (order >= len(ids_a)).astype(np.int64)
    by = np.argsort(group * 2 + side, kind="stable")
    token, group, side = order[by], group[by], side[by]
    follows = np.full(len(by), 3)
    follows[:-1] = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
    edges = at_a + at_b  # both sides' tokens of a text lie together
    follows[edges[1:] - 1] = 0
    words = np.empty(len(by), object)
    words[side == 0] = a.pool.text[ids_a[token[side == 0]] * 4 + follows[side == 0]]
    words[side == 1] = b.pool.text[ids_b[token[side == 1] - len(ids_a)] * 4 + follows[side == 1]]
    words = words.tolist()
    cuts = np.searchsorted(link_start, bounds)
    for j, i in enumerate(good):
        lo, hi = edges[j : j + 2]
        digest = hashlib.sha256("".join(words[lo:hi]).encode()).hexdigest()
        out[i] = [int(at_a[j + 1] - at_a[j]), int(at_b[j + 1] - at_b[j]), int(group[hi - 1] - group[lo]) + 1, int(cuts[j + 1] - cuts[j]), digest]
    key = ids_a[link_a] * len(b.pool.size) + ids_b[link_b]
    text = np.repeat(good, np.diff(cuts))
    span = len(a.pool.size) * len(b.pool.size)
    pairs, times = np.unique(text * span + key, return_counts=True)
    return out, pairs // span, pairs % span, times


def _added_up(block: pa.Table, names: list[str]) -> pa.Table:
    """The texts of a block with what the counts of its pairs add up to for each."""
    grow = held("align sums", None, zstandard.ZstdDecompressor)  # a worker that comes here needs its tokenizers no more
    block = block.combine_chunks()
    there = block.column("key").is_valid()
    pairs, docs = block.filter(there), block.filter(pa.compute.invert(there))
    by = np.argsort(pairs.column("key").to_numpy())
    n, first = pairs.column("n").to_numpy()[by], pairs.column("best").to_numpy()[by]
    sums, bests = [], []
    for data in docs.column("links"):
        at, times = _unpack(grow.decompress(data.as_py()))
        sums.append(int((n[at] * times).sum()))
        bests.append(int(times[first[at].astype(bool)].sum()))
    made = pa.table([*[docs.column(c) for c in names[:-2]], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=names)
    del block, there, pairs, docs
    trim()
    return made


def align(df: DataFrame, a_path: str, b_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with n_a, n_b, n_groups, n_links, n_best, count_sum long and groups_sha256 string.

    Each text is encoded without special tokens, their strings as plain text:
    a space and the text by the byte-level file ``a_path``, the text by the
    sentencepiece file ``b_path``, which adds that space.  Groups lie between
    the bytes where tokens of both sides end; a link is an A and a B token that
    share bytes.  A pair of ids counts as often as it is linked in the whole
    table; ``count_sum`` adds that over a text's links and ``n_best`` tells
    how many have the highest count of their B id, ties included.

    A block of texts lists its distinct id pairs once.  Pairs are counted by
    key over the blocks, the highest count per B id (as many rows as the B
    vocabulary has) is broadcast, and each block gets the counts of its pairs
    back, which its texts, kept as numbers into the block's list, add up.

    Null and empty texts, and those whose tokens do not join to a space and
    the text, have zeros and ''.  A very long text is a block of its own.
    Repeated rows count each time and give a row each.  An empty table gives
    none.  Columns of ``df`` with a result's name are replaced.
    """
    spark = df.sparkSession
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))  # about two megabytes, fixed
    counted = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())])
    results = {*counted.names, "n_best", "count_sum"}
    own = [c for c in (df.columns if keep is None else keep) if c.lower() not in results]
    own_type = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(own)])
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("own") if own else F.lit(None).cast("struct<c:int>").alias("own"), F.col(text_col).alias("text"))
    own_type = rows.schema["own"].dataType
    pairs_type = [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("own", own_type), *counted.fields, T.StructField("links", T.BinaryType()), *pairs_type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(files, pattern)
        task, made, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = strings(batch, "text")
            for lo, hi in slices(buffers(texts)[1], BLOCK_BYTES):
                results, text, keys, times = [], [], [], []
                for x, y in slices(buffers(texts[lo:hi])[1]):
                    out, *found = _aligned(texts[lo + x : lo + y], a, b)
                    results += out
                    for to, part in zip((text, keys, times), (found[0] + x, found[1], found[2]), strict=True):
                        to.append(part)
                text, keys, times = map(np.concatenate, (text, keys, times))
                distinct, number = np.unique(keys, return_inverse=True)
                total = np.bincount(number, times, len(distinct)).astype(np.int64)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                links = [_pack(np.diff(number[s:e], prepend=0), times[s:e], squeeze) for s, e in itertools.pairwise(cuts)]
                lead = [distinct] + [None] * (hi - lo - 1), [total] + [None] * (hi - lo - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{made}"] * (hi - lo)), batch.column(0).slice(lo, hi - lo),
                    *[pa.array([r[k] for r in results], pa.int64()) for k in range(4)], pa.array([r[4] for r in results], pa.string()),
                    pa.array(links, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in lead],
                ], names=schema.names)
                made += 1
                del results, text, keys, times, distinct, number, links, lead
                trim()

    stored = cut(rows.mapInArrow(freeing(run), schema))
    n_b = len(_loaded(files, pattern)[1].pool.size)
    listed = stored.where(F.col("keys").isNotNull()).select("block", F.inline(F.arrays_zip("keys", "times"))).withColumnsRenamed({"keys": "key"})
    counts = cut(listed.groupBy("key").agg(F.sum("times").alias("n")))
    best = counts.groupBy((F.col("key") % n_b).alias("b")).agg(F.max("n").alias("most"))
    flagged = counts.join(F.broadcast(best), F.col("key") % n_b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    looked = listed.select("block", "key").join(flagged, "key")
    both = stored.drop("keys", "times").unionByName(looked, allowMissingColumns=True)
    out = T.StructType([T.StructField("own", own_type), *counted.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    done = both.groupBy("block").applyInArrow(lambda block: _added_up(block, out.names), out)
    return done.select(*[F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(own)], *counted.names, "n_best", "count_sum")
