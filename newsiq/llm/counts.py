"""Token counts: pieces of each distinct pre-token, summed over per-document pre-token frequencies."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, held, slices, strings

#: Texts are counted in blocks of at most so many rows, and of about so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 24
#: Parts that pre-tokens are dealt to, for each shuffle partition of the session, which a cluster sets by its data: so
#: many that partitions get about the same. A task holds the distinct pre-tokens of one bunch of its parts at a time.
PARTS_EACH, BUNCHES = 16, 4

_FLAGS = ("single_word", "lstrip", "rstrip", "normalized")


def _splitter(data: bytes, pattern: str):
    """text -> its pre-tokens, with special strings as pre-tokens of their own, as the tokenizer file says."""
    spec = json.loads(data)
    split = spec["pre_tokenizer"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
        raise ValueError("only byte-level tokenizers without normalizer and prefix space")
    if any(t[f] for t in spec["added_tokens"] for f in _FLAGS):
        raise ValueError("added tokens with options are not supported")
    pieces = regex.compile(pattern)
    added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    if not added:
        return pieces.findall
    special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")

    def pre_tokens(text: str) -> list[str]:
        if not special.search(text):
            return pieces.findall(text)
        parts = special.split(text)
        return [t for i, p in enumerate(parts) for t in ([p] if i % 2 else pieces.findall(p))]

    return pre_tokens


def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def load():
        made = Tokenizer.from_str(data.decode())
        made.no_truncation()
        made.no_padding()
        return made

    return held("counts", hash(data), load)


def _block(texts: list[str], split, parts: int) -> Iterator[tuple]:
    """(part, pre-tokens, documents with each, document numbers, frequencies) of one block."""
    number = defaultdict(itertools.count().__next__)
    tokens, docs, counts = [], [], []
    for i, text in enumerate(texts):
        ids, n = np.unique(np.fromiter(map(number.__getitem__, split(text)), np.int32), return_counts=True)
        tokens.append(ids)
        counts.append(n.astype(np.int32))
        docs.append(np.full(len(ids), i, np.int16))
    if not number:
        return
    words = np.array(list(number), object)
    part = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % parts for w in words), np.int32, len(words))
    tokens, docs, counts = map(np.concatenate, (tokens, docs, counts))
    by = np.argsort(part, kind="stable")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    order = np.argsort(place[tokens], kind="stable")
    tokens, docs, counts, edges = place[tokens][order], docs[order], counts[order], np.searchsorted(part[by], np.arange(parts + 1))
    cuts = np.searchsorted(tokens, edges)
    per = np.bincount(tokens, minlength=len(words)).astype(np.int32)
    for p in range(parts):
        (lo, hi), (a, b) = edges[p : p + 2], cuts[p : p + 2]
        if lo < hi:
            yield p, words[by[lo:hi]].tolist(), per[lo:hi], docs[a:b], counts[a:b]


def token_counts(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens): UTF-8 length and number of tokens of every whole text.

    Equal to what the tokenizer gives for the text without begin or end
    tokens, truncation and padding; special strings inside a text count as the
    tokenizer's special tokens, its default.

    Texts are counted in blocks: a block's distinct pre-tokens with their
    documents and frequencies are dealt by pre-token to ``parts`` parts (by
    default ``PARTS_EACH`` for each shuffle partition).  A
    task takes its parts in ``BUNCHES`` bunches, counts the pieces of each
    distinct pre-token of a bunch once, joins them to the frequencies and adds
    up per document; only the sums of a block's bunches, at most ``parts``
    rows, meet again.  Ids are never kept.
    A frequent pre-token is one entry per block, so no task gets its
    occurrences.

    A null text counts as empty (0 bytes, 0 tokens).  Every row gives a row,
    also repeated rows and null ids.  An empty table gives none.  Other columns
    are ignored.  ``df`` should be a stored table or deterministic.
    """
    spark = df.sparkSession
    parts = parts or PARTS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer_path, "rb") as f:
        files = spark.sparkContext.broadcast(f.read())  # about two megabytes, fixed
    id_type = df.schema[id_col].dataType
    dealt = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("rows", T.IntegerType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_bytes", T.ArrayType(T.LongType())),
        T.StructField("pre_tokens", T.ArrayType(T.StringType())), T.StructField("n_docs", T.ArrayType(T.IntegerType())),
        T.StructField("docs", T.ArrayType(T.ShortType())), T.StructField("freqs", T.ArrayType(T.IntegerType())),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, task = _splitter(files.value, pattern), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0), strings(batch, text_col)
            sizes = np.diff(buffers(texts)[1])
            for lo, hi in slices(buffers(texts)[1], BLOCK_BYTES):
                for at in range(lo, hi, BLOCK_ROWS):
                    end = min(at + BLOCK_ROWS, hi)
                    name, n = f"{task}-{seen}", end - at
                    seen += 1
                    rows = [(-1 - (task + seen) % parts, None, None, None, None), *_block(texts[at:end].to_pylist(), split, parts)]
                    first = [True] + [False] * (len(rows) - 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([n] * len(rows), pa.int32()),
                        pa.array([ids[at:end].to_pylist() if f else None for f in first], pa.list_(ids.type)),
                        pa.array([sizes[at:end] if f else None for f in first], pa.list_(pa.int64())),
                        *[pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in ((1, pa.string()), (2, pa.int32()), (3, pa.int16()), (4, pa.int32()))],
                    ], names=dealt.names)

    # a text has fewer than 2**31 bytes, and a token has one at least
    summed = T.StructType([*dealt.fields[:5], T.StructField("sums", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, bunch, pieces = _tokenizer(files.value), None, {}
        block, total = None, None  # what the bunch's parts of a block, which come one after another, add up to

        def added(schema: pa.Schema, sums: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
            n, sizes = len(sums), [len(t) for _, t in sums]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in sums], schema.field(0).type), pa.nulls(n, pa.int32()), pa.array(sizes, pa.int32()),
                *[pa.nulls(n, schema.field(k).type) for k in (3, 4)], pa.array([t.astype(np.int32) for _, t in sums], pa.list_(pa.int32())),
            ], names=summed.names)

        for batch in batches:
            sums, parts_of = [], batch.column(1).to_numpy()
            headers = batch.filter(pa.array(parts_of < 0))
            if headers.num_rows:
                yield pa.RecordBatch.from_arrays([*headers.columns[:5], pa.nulls(headers.num_rows, pa.list_(pa.int32()))], names=summed.names)
            for i in np.flatnonzero(parts_of >= 0).tolist():
                at = int(parts_of[i]) % BUNCHES, batch.column(0)[i].as_py()
                if total is not None and at != (bunch, block):
                    sums.append((block, total))
                    total = None
                if at[0] != bunch:
                    bunch, pieces = at[0], {}
                if total is None:
                    block, total = at[1], np.zeros(batch.column(2)[i].as_py(), np.int64)
                words = batch.column(5)[i].as_py()
                new = [w for w in words if w not in pieces]
                pieces.update((w, len(e.ids)) for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)))
                per, docs, freqs = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (6, 7, 8))
                each = np.repeat(np.array([pieces[w] for w in words], np.int64), per) * freqs
                np.add.at(total, docs, each)
            if sums:
                yield added(batch.schema, sums)
        if total is not None:
            yield added(batch.schema, [(block, total)])

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def total(group: pa.Table) -> pa.Table:
        lists = group.column("sums").drop_null()
        n = group.column("rows")[0].as_py()
        tokens = np.sum([x.values.to_numpy(zero_copy_only=False) for x in lists], axis=0, dtype=np.int64) if len(lists) else np.zeros(n, np.int64)
        ids, sizes = (group.column(c).combine_chunks().drop_null().flatten() for c in ("ids", "n_bytes"))
        return pa.table([ids, sizes, pa.array(tokens, pa.int64())], names=out.names)

    rows = df.select(F.col(id_col), F.col(text_col)).mapInArrow(deal, dealt)
    by_part = rows.repartition("part").sortWithinPartitions(F.pmod("part", F.lit(BUNCHES)), "block")
    return by_part.mapInArrow(count, summed).groupBy("block").applyInArrow(total, out)
