"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive tokens; the tokens at its zeros are
ignored.  Test and training texts that share the tokens at a mask's ones get
the same hash.  Around each shared hash the two texts are laid side by side
and an overlap is confirmed when enough tokens of a long enough run agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, cut, free_name, freeing, slices, strings
from newsiq.llm.hashing import constants, run_hashes, word_hashes, word_spans

#: Together these two find every run of 13 tokens of which any 2 are substituted.
MASKS = ("11010111", "11110011")
#: Tokens of an overlap (of the whole item, if that is shorter), and how many of them may differ.
OVERLAP, SUBSTITUTED = 13, 2
#: Bits of the filter over all test hashes (16 MB); raise it beyond about ten million test hashes.
FILTER_BITS = 27

#: Fewest tokens of an item that is looked for, and the most that a whole-item seed covers.
SHORTEST, SHORT = 3, 9

_SPAN = len(MASKS[0])
_PICKS = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]


def _short_masks(n: int) -> dict[int, np.ndarray]:
    """Masks over an item of ``n`` tokens as a whole: all tokens or, where one may differ, all but one."""
    if SUBSTITUTED * n // OVERLAP == 0:
        return {10 + n: np.arange(n)}
    return {10 * (n - 5) + gap: np.delete(np.arange(n), gap) for gap in range(n)}


_WHOLE = {mask: (n, picks) for n in range(SHORTEST, SHORT + 1) for mask, picks in _short_masks(n).items()}
_SECOND = constants(1, 9)[0]
_SIGNS = r"[^\p{L}\p{N}\p{M}]+"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)"
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _plain(column: str):
    return F.lower(F.coalesce(F.col(column), F.lit(""))).alias("_plain")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, first token of each text): runs of letters, digits and combining marks.

    In scripts that are written without spaces each character is a token.
    Test and training texts both come here, so both are cut by this one rule.
    """
    raw, offsets = buffers(texts)
    if len(raw) and raw.max() >= 0xE0:  # the first byte of all characters of these scripts
        texts = pc.replace_substring_regex(texts, _UNSPACED, r" \1 ")
    if len(raw) and raw.max() >= 0x80:
        raw, offsets = buffers(pc.replace_substring_regex(texts, _SIGNS, " "))
    starts, ends, first = word_spans(raw, offsets, _TOKEN)
    return word_hashes(raw, starts, ends), first


def _seeds(words: np.ndarray, first: np.ndarray, whole: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, positions, hashes) of the seeds that lie inside one text, for the two masks and those of ``whole``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def inside(span: int) -> np.ndarray:
        n = max(0, len(words) - span + 1)
        return np.flatnonzero(text[:n] == text[len(words) - n :]) if n else np.zeros(0, np.int64)

    at = inside(_SPAN)
    for m, picks in enumerate(_PICKS):
        yield m, at, run_hashes(words, picks, m + 1)[at]
    for m in whole:
        span, picks = _WHOLE[m]
        at = inside(span)
        yield m, at, run_hashes(words, picks, m + 1)[at]


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    move = np.uint64(64 - bits)
    return hashes >> move, (hashes * _SECOND) >> move


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def test_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, at, mask, hash, tokens): every seed of every distinct test text.

    Texts that differ only in case or signs are one item, under the smallest
    id; one of at most ``SHORT`` tokens also has seeds over the whole of it,
    one of fewer than ``SHORTEST`` has none.  ``tokens`` is only set on the
    first seed of an item.
    """
    kind = benchmark.schema[id_col].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("at", T.IntegerType()), T.StructField("mask", T.ByteType()), T.StructField("hash", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), strings(batch, "_plain")
            for lo, hi in slices(buffers(texts)[1]):
                words, first = _tokens(texts[lo:hi])
                for mask, at, hashes in _seeds(words, first, list(_WHOLE)):
                    row = np.searchsorted(first, at, "right") - 1
                    if mask in _WHOLE:
                        fits = np.flatnonzero(np.diff(first)[row] == _WHOLE[mask][0])
                        at, hashes, row = at[fits], hashes[fits], row[fits]
                    lead = (mask == (0 if mask not in _WHOLE or _WHOLE[mask][0] >= _SPAN else min(_short_masks(_WHOLE[mask][0])))) & (at == first[row])
                    lists = [words[first[r] : first[r + 1]].view(np.int64) if new else None for r, new in zip(row, lead, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        ids[lo:hi].take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), pa.array(np.full(len(at), mask, np.int8)),
                        _signed(hashes), pa.array(lists, pa.list_(pa.int64())),
                    ], names=schema.names)

    one = benchmark.select(F.col(id_col).alias("item_id"), _plain(text_col)).withColumn("_words", F.regexp_replace("_plain", _SIGNS, " "))
    return one.groupBy("_words").agg(F.min("item_id").alias("item_id"), F.min("_plain").alias("_plain")).select("item_id", "_plain").mapInArrow(freeing(run), schema)


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit array over all test hashes, two bits each; its size is fixed by ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = seeds.select("hash").mapInArrow(freeing(run), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _segments(df: DataFrame, id_col: str, text_col: str, table: np.ndarray, bits: int, whole: list[int]) -> DataFrame:
    """Stretches of training tokens around seeds that pass the filter, with those seeds."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("segment", T.StringType()), T.StructField("id", kind), T.StructField("text_hash", T.LongType()),
        T.StructField("start", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType())), T.StructField("hash", T.ArrayType(T.LongType())),
    ])
    reach = OVERLAP - _SPAN  # an overlap around a seed starts and ends at most so many tokens away from it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, hashed, texts = batch.column(0), batch.column(1), strings(batch, "_plain")
            for lo, hi in slices(buffers(texts)[1]):
                words, first = _tokens(texts[lo:hi])
                found = []
                for mask, at, hashes in _seeds(words, first, whole):
                    one, two = _bits(hashes, bits)
                    hit = np.flatnonzero(_has(shared.value, one))
                    hit = hit[_has(shared.value, two[hit])]
                    found.append((at[hit], np.full(len(hit), mask, np.int8), hashes[hit]))
                at, mask, hashes = map(np.concatenate, zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, mask, hashes = at[order], mask[order], hashes[order]
                row = np.searchsorted(first, at, "right") - 1
                cuts = np.flatnonzero((np.diff(at) > _SPAN + 2 * reach) | (np.diff(row) > 0)) + 1
                rows = []
                for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    r = row[a]
                    start, end = max(first[r], at[a] - reach), min(first[r + 1], at[b - 1] + _SPAN + reach)
                    rows.append((f"{task}-{made}", r, start - first[r], words[start:end].view(np.int64), (at[a:b] - start).astype(np.int32), mask[a:b], hashes[a:b].view(np.int64)))
                    made += 1
                at_row = pa.array([lo + x[1] for x in rows])
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in rows]), ids.take(at_row), hashed.take(at_row), pa.array([x[2] for x in rows], pa.int32()),
                    *[pa.array([x[k] for x in rows], pa.list_(t)) for k, t in ((3, pa.int64()), (4, pa.int32()), (5, pa.int8()), (6, pa.int64()))],
                ], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _plain(text_col)).mapInArrow(freeing(run), schema)


def confirm(segment: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) in ``segment`` of the overlap with ``item`` laid ``shift`` tokens in, or None.

    An overlap is made of runs of ``OVERLAP`` tokens (the whole item, if
    shorter) in which at most ``SUBSTITUTED`` tokens differ, in proportion for
    shorter items.
    """
    lo, hi = max(0, shift), min(len(segment), shift + len(item))
    n = min(OVERLAP, len(item))
    if hi - lo < n:
        return None
    same = segment[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    runs = np.flatnonzero(total[n:] - total[:-n] >= n - SUBSTITUTED * n // OVERLAP)
    if not len(runs):
        return None
    start, end = int(runs[0]), int(runs[-1]) + n
    return lo + start, lo + end, int(total[end] - total[start])


def overlaps(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", bits: int = FILTER_BITS
) -> DataFrame:
    """(id, text_hash, item_id, start, end, n_equal): the confirmed overlaps of documents with test texts.

    One row per document, item and alignment's outermost token positions; the
    token counts are over letters-and-digits words in lower case.  Every
    overlap of ``OVERLAP`` tokens with at most ``SUBSTITUTED`` substitutions
    is found, and of a shorter item a copy with substitutions in proportion
    (one from seven tokens on).  Test texts of one or two tokens never match;
    texts equal up to case and signs are one item under the smallest id.

    Training texts are scanned once; a fixed-size filter of the test hashes
    goes to all tasks, and only stretches that pass it are stored, then joined
    with the test hashes and compared.  A frequent hash is split by the
    adaptive planner, as its test side has one row per item that holds it.

    Null texts count as empty and give nothing, as do empty tables.  Repeated
    rows give one row.  Null ids are ids.  Other columns are ignored.
    """
    seeds = cut(test_seeds(benchmark, item_id_col, "text"))
    table = _filter(seeds, bits)
    whole = sorted(r["mask"] for r in seeds.select("mask").distinct().collect() if r["mask"] in _WHOLE)  # of the lengths there are
    segments = cut(_segments(df, id_col, text_col, table, bits, whole))
    hits = segments.select("segment", F.explode(F.arrays_zip("at", "mask", "hash")).alias("h")).select("segment", "h.at", "h.mask", "h.hash")
    test = seeds.select("item_id", F.col("at").alias("item_at"), "mask", "hash")
    laid = hits.join(test, ["hash", "mask"]).select("segment", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    items = seeds.where(F.col("tokens").isNotNull()).select("item_id", F.col("tokens").alias("item"))
    rows = laid.join(segments.select("segment", "id", "text_hash", "start", "tokens"), "segment")
    rows = rows.join(items.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
    rows = rows.select("id", "text_hash", "item_id", "start", "shift", "tokens", "item")
    kind, item_kind = df.schema[id_col].dataType, benchmark.schema[item_id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("text_hash", T.LongType()), T.StructField("item_id", item_kind), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("n_equal", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift, start = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            found = [confirm(batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy(), int(shift[i])) for i in range(batch.num_rows)]
            at = np.array([i for i, f in enumerate(found) if f], np.int64)
            spans = np.array([f for f in found if f], np.int32).reshape(-1, 3)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k).take(take) for k in range(3)],
                pa.array(spans[:, 0] + start[at], pa.int32()), pa.array(spans[:, 1] + start[at], pa.int32()), pa.array(spans[:, 2], pa.int32()),
            ], names=out.names)

    pairs = rows.mapInArrow(freeing(run), out).groupBy("id", "text_hash", "item_id")
    best = pairs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_equal").alias("n_equal"))
    return best.withColumnRenamed("id", id_col)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its own columns, that overlap no test text.

    Rows are matched by id and text, so a clean row stays also where another
    row has its id, or none.
    """
    bad, text = free_name(df, "_bad_id"), free_name(df, "_bad_hash")
    found = cut(overlaps(df, benchmark, id_col, text_col).select(F.col(id_col).alias(bad), F.col("text_hash").alias(text)).distinct())
    return df.join(found, F.col(id_col).eqNullSafe(F.col(bad)) & (F.xxhash64(text_col) == F.col(text)), "left_anti")
