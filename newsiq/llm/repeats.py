"""Removal of byte passages that occur twice, by sorting sampled positions and the windows between them.

The suffixes to compare are the windows of ``length`` bytes.  As in a
difference cover, only sampled positions are sorted at first, and any two
equal windows hold a sampled position at the same offset.  The sample is
chosen by content (in each window the substring with the least hash), which
gives that property with 2 positions in ``length`` bytes.  Names are hashes.
Samples whose name occurs once cannot lie in a repeated window and drop out;
the windows around the others are named by the middle they share (a name over
almost the whole window) and the few bytes before and after it, sorted by
these triples, and neighbours are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, cut, slices, strings
from newsiq.llm.hashing import mix

#: Windows that share one middle; the first and last ``STEP - 1`` bytes of them are kept as they are.
STEP = 17
#: A sample name this frequent has its windows counted one by one, by their own names.
HOT = 20_000
#: Bits, as a power of two, of the filters of repeated names and of texts with repeats, and of that of frequent names.
FILTER_BITS, HOT_BITS = 27, 20
#: Bytes that are hashed at once; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SIDE = STEP - 1


class _Hasher:
    """Hashes of substrings of a piece, from prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, raw: np.ndarray) -> None:
        if len(self.up) <= len(raw):
            size = max(len(raw) + 1, 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.total[1:])

    def all(self, size: int) -> np.ndarray:
        n = max(0, len(self.total) - size)
        return mix((self.total[size:] - self.total[:n]) * self.down[:n])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.down[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def _sizes(length: int) -> tuple[int, int]:
    """(bytes of a sample, sample positions in a window)."""
    size = max(1, length // 3)
    size += (length - size + 1) % STEP  # windows around a sample are whole steps
    return size, length - size + 1


def _samples(raw: np.ndarray, ends: np.ndarray, length: int, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, first and last window) of the samples of a slice; ``ends`` are those of its texts."""
    none = np.zeros(0, np.int64)
    size, width = _sizes(length)
    if len(raw) < length:
        return none, none.view(np.uint64), none, none
    hasher.load(raw)
    names = hasher.all(size)
    low = np.uint64((1 << 24) - 1)  # equal names: the first position
    least = _least((names & ~low) | np.arange(len(names), dtype=np.uint64), width)
    at = (least & low).astype(np.int64)
    crosses = np.zeros(len(at) + 1, np.int32)
    inner = ends[:-1]
    lo = np.maximum(inner - length + 1, 0)
    np.add.at(crosses, np.minimum(lo, len(at)), 1)
    np.add.at(crosses, np.minimum(inner, len(at)), -1)
    window = np.flatnonzero(np.cumsum(crosses[:-1]) == 0)
    if not len(window):
        return none, none.view(np.uint64), none, none
    at = at[window]
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], names[at[first]], window[first], window[last]


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of texts, text number of each, bytes of the text before it) of slices of about ``PIECE`` bytes."""
    raw, offsets = buffers(texts)
    for lo, hi in slices(offsets, PIECE):
        start, end = offsets[lo], offsets[hi]
        if end - start <= 2 * PIECE:
            yield raw[start:end], offsets[lo + 1 : hi + 1] - start, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        else:  # one long text
            for at in range(0, end - start - length + 1, PIECE):
                part = raw[start + at : min(end, start + at + PIECE + length - 1)]
                yield part, np.array([len(part)]), np.array([lo]), np.array([at])


def _bit(names: np.ndarray, bits: int) -> np.ndarray:
    return mix(names) >> np.uint64(64 - bits)  # names of samples are small numbers, so mixed again


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash of ``names`` (a long column); its size is fixed by ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = names.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _has(table: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    at = _bit(names, bits)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _names(texts: DataFrame, length: int) -> DataFrame:
    """(name, n): how often each sample name occurs in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            for raw, ends, _, _ in _pieces(strings(batch, "text"), length):
                name, n = np.unique(_samples(raw, ends, length, hasher)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n, pa.int64())], names=["name", "n"])

    return texts.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def _word(raw: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Eight bytes from ``start`` as a big-endian number; bytes outside [low, high) are 0."""
    at = start[:, None] + np.arange(8)
    inside = (at >= low[:, None]) & (at < high[:, None])
    bytes_ = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)], 0).astype(np.uint8)
    return np.ascontiguousarray(bytes_).view(">u8").ravel().astype(np.uint64)


_OPEN = T.StructType([T.StructField(n, T.LongType()) for n in ("text_1", "text_2", "place", "middle", "l1", "l2", "r1", "r2")] + [T.StructField("hot", T.BooleanType())])
_STEPS = (1 << STEP) - 1


def _middles(texts: DataFrame, length: int, repeated, hot, bits: int) -> DataFrame:
    """Rows for each step of windows around a sample whose name occurs twice.

    ``place`` is the byte where the middle starts and, in its low ``STEP``
    bits, bit j if the window that starts j bytes before is one of the
    sample's; such a window is the last j bytes before the middle, the middle,
    and the first bytes after it.
    """
    core = length - _SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            one, two = (batch.column(k).to_numpy() for k in (0, 1))
            for raw, ends, number, before in _pieces(strings(batch, "text"), length):
                at, name, first, last = _samples(raw, ends, length, hasher)
                kept = np.flatnonzero(_has(repeated.value, name, bits))
                at, name, first, last = at[kept], name[kept], first[kept], last[kept]
                if not len(at):
                    continue
                frequent = _has(hot.value, name, HOT_BITS)
                lo, hi = (at - last) // STEP, (at - first) // STEP  # steps before the sample
                each = hi - lo + 1
                row = np.repeat(np.arange(len(at)), each)
                step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + lo[row]
                base = at[row] - step * STEP
                windows = np.zeros(len(row), np.int64)
                for j in range(STEP):
                    windows |= ((base - j >= first[row]) & (base - j <= last[row])).astype(np.int64) << j
                text = np.searchsorted(ends, at[row], "right")
                low, high = np.concatenate([[0], ends[:-1]])[text], ends[text]
                # a step's base may lie outside the text only where its windows do not
                inside = (base >= low) & (base + core <= high)
                middle = np.zeros(len(row), np.uint64)
                middle[inside] = hasher.at(base[inside], core)
                middle = mix(middle + step.astype(np.uint64) * np.uint64(_BASE))
                sides = [_word(raw, base + k, low, high) for k in (-16, -8, core, core + 8)]
                ids = number[text]
                yield pa.RecordBatch.from_arrays([
                    pa.array(one[ids]), pa.array(two[ids]), pa.array(base - low + before[text] << STEP | windows), pa.array(middle.view(np.int64)),
                    *[pa.array(x.view(np.int64)) for x in sides], pa.array(frequent[row]),
                ], names=_OPEN.names)

    return texts.mapInArrow(run, _OPEN)


def _window_names(middle: np.ndarray, sides: list[np.ndarray], j: int) -> np.ndarray:
    """Names of the windows that start ``j`` bytes before the middle."""
    l1, l2, r1, r2 = sides
    ones = (1 << 64) - 1
    after = _SIDE - j
    left = [np.uint64((1 << 8 * max(0, j - 8)) - 1), np.uint64((1 << 8 * min(8, j)) - 1)]
    right = [np.uint64(ones ^ ((1 << 8 * (8 - min(8, after))) - 1)), np.uint64(ones ^ ((1 << 8 * (8 - max(0, after - 8))) - 1))]
    out = middle + np.uint64(j)
    for k, (word, mask) in enumerate(zip((l1, l2, r1, r2), left + right, strict=True)):
        out = mix(out * np.uint64(_BASE) + (word & mask) + np.uint64(k))
    return out


def _repeated_bits(middle: np.ndarray, sides: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The bits of ``windows`` whose window occurs again in these rows."""
    found = np.zeros(len(middle), np.int64)
    for j in range(STEP):
        has = np.flatnonzero(windows >> j & 1)
        if not len(has):
            continue
        names = _window_names(middle[has], [s[has] for s in sides], j)
        order = np.argsort(names)
        names = names[order]
        same = np.concatenate([[False], names[1:] == names[:-1], [False]])
        found[has[order[same[1:] | same[:-1]]]] |= 1 << j
    return found


_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("text_1", "text_2", "found")])


def _compared(rows: DataFrame) -> DataFrame:
    """(text, found) of rows whose middles are not too frequent; a middle's rows meet in one task, a batch of middles at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
            one, two, place, middle, *sides = columns
            bits = _repeated_bits(middle.view(np.uint64), [s.view(np.uint64) for s in sides], place & _STEPS)
            some = bits != 0
            return pa.RecordBatch.from_arrays([pa.array(one[some]), pa.array(two[some]), pa.array((place & ~_STEPS | bits)[some])], names=_FOUND.names)

        n = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(8)])
            n += batch.num_rows
            if n < 100_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = int(np.searchsorted(columns[3], columns[3][-1]))  # the last middle may go on
            if whole:
                yield settle([c[:whole] for c in columns])
            held = [[c[whole:] for c in columns]]
            n = len(held[0][0])
        if n:
            yield settle([np.concatenate(c) for c in zip(*held, strict=True)])

    by = rows.drop("hot").repartition("middle").sortWithinPartitions("middle")
    return by.mapInArrow(run, _FOUND)


def _counted(rows: DataFrame) -> DataFrame:
    """(text, found) of rows with frequent samples: each window is a row, counted by its name in partial sums."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("text_1", "text_2", "found", "name", "name_2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, place, middle, *sides = (batch.column(k).to_numpy() for k in range(8))
            sides = [s.view(np.uint64) for s in sides]
            for j in range(STEP):
                has = np.flatnonzero(place >> j & 1)
                part = [s[has] for s in sides]
                names = [_window_names(middle[has].view(np.uint64) * np.uint64(f), part, j) for f in (1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[has], two[has], place[has] & ~_STEPS | 1 << j, *[n.view(np.int64) for n in names])], names=schema.names)

    windows = rows.drop("hot").mapInArrow(run, schema)
    # written first: only a join of two plain exchanges is split where a window is frequent
    twice = cut(windows.groupBy("name", "name_2").agg(F.count("*").alias("n")).where("n > 1").select("name", "name_2"))
    return windows.join(twice, ["name", "name_2"]).select("text_1", "text_2", "found")


def find_repeats(df: DataFrame, text_col: str = "text", length: int = 200, bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(text_1, text_2, found): the repeated windows of each distinct text, which its two hashes name.

    ``found`` lists numbers; bit j of the low ``STEP`` bits of one says that
    the window j bytes before position ``found >> STEP`` occurs again.
    """
    if length < 24:
        raise ValueError("passages have 24 bytes at least")
    context = df.sparkSession.sparkContext
    texts = df.select(F.xxhash64(text_col).alias("text_1"), F.xxhash64(F.lit(1), text_col).alias("text_2"), F.col(text_col).alias("text"))
    texts = texts.where(F.octet_length("text") >= length)
    names = cut(_names(texts, length).where("n > 1"))
    repeated = context.broadcast(_filter(names.select("name"), bits))
    frequent = context.broadcast(_filter(names.where(F.col("n") > hot).select("name"), HOT_BITS))
    rows = cut(_middles(texts, length, repeated, frequent, bits))
    found = _compared(rows.where("NOT hot")).unionAll(_counted(rows.where("hot")))
    return found.groupBy("text_1", "text_2").agg(F.collect_set("found").alias("found"))


def spans(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that repeated windows cover."""
    at = np.concatenate([(found >> STEP)[(found >> j & 1) > 0] - j for j in range(STEP)])
    at = np.unique(at)
    cuts = np.flatnonzero(np.diff(at) > length) + 1
    return at[np.concatenate([[0], cuts])], at[np.append(cuts, len(at)) - 1] + length


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = 200, keep: list[str] | None = None, bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """``keep`` (default: all columns) with kept binary, n_bytes and n_removed long, and spans array<struct<start, end: long>>.

    Every byte of a text that is covered by a string of ``length`` bytes which
    starts anywhere else in the table's texts, the same text included, is
    removed; ``kept`` has the others, ``spans`` the maximal removed runs.
    Occurrences may overlap, and all is judged on the texts as they come.
    Repeated rows are occurrences of each other.

    Two scans of the texts: the first counts sample names (in partial sums);
    the second ships, for samples whose name occurs twice, rows of fixed size.
    A fixed filter of ``2 ** bits`` bits carries the repeated names to the
    second scan; it only saves work.  A middle's rows meet in one task, except
    those of samples more frequent than ``hot``, whose windows are counted by
    their names.  Results meet their texts by the texts' hashes; a second
    filter lets texts without repeats pass by.

    Null texts count as empty; they and texts below ``length`` bytes stay
    whole.  Very long texts are handled in overlapping pieces and rebuilt
    whole.  An empty table gives none.  Null ids are ids.  Columns of ``df``
    with a result's name are replaced.
    """
    context = df.sparkSession.sparkContext
    found = cut(find_repeats(df, text_col, length, bits, hot))
    some = context.broadcast(_filter(found.select("text_1"), bits))
    added = "kept binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>"
    new = T.StructType.fromDDL(added)
    own = [c for c in (df.columns if keep is None else keep) if c.lower() not in new.names]
    rows = df.select(
        F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("own"),
        F.xxhash64(text_col).alias("text_1"), F.xxhash64(F.lit(1), text_col).alias("text_2"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    out = T.StructType([rows.schema["own"], *new.fields])

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for i in range(batch.num_rows):
                text, at = batch.column(1)[i].as_py().encode(), batch.column(2)[i]
                starts, ends = spans(at.values.to_numpy(), length) if at.is_valid else (np.zeros(0, np.int64),) * 2
                kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)))
                sizes.append(len(text))
                removed.append(int((ends - starts).sum()))
                runs.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip((kept, sizes, removed, runs), kinds, strict=True)]], names=out.names)

    @F.pandas_udf("boolean")
    def maybe(text_1: pd.Series) -> pd.Series:
        return pd.Series(_has(some.value, text_1.to_numpy().view(np.uint64), bits))

    all_rows = rows.withColumn("maybe", maybe("text_1"))
    whole = all_rows.where("NOT maybe").select("own", F.col("text").cast("binary").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(new["spans"].dataType).alias("spans"))
    hit = all_rows.where("maybe").join(found, ["text_1", "text_2"], "left").select("own", "text", "found").mapInArrow(take_out, out)
    return hit.unionByName(whole).select(*[F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(own)], *new.names)
