"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, cut, free_name, freeing, slices, strings
from newsiq.llm.graph import components
from newsiq.llm.hashing import constants, mix, word_hashes, word_spans

#: Words of a shingle and the similarity, in percent, from which two documents are linked.
WORDS, PERCENT = 5, 75
#: Chance that a pair at the threshold shares no band, and minimum hashes of a band.
BAND_MISS, ROWS = 1e-4, 6
#: Chance per step that a pair at or above the threshold is pruned, and hashes of a step.
PRUNE_MISS, STEP = 1e-6, 32
#: Members of a bucket that one task compares with the whole bucket.
CHUNK = 1024

# Words are runs of bytes other than space and 0x09 to 0x0D; A-Z are lower-cased.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def bands(percent: int = PERCENT, rows: int = ROWS, miss: float = BAND_MISS) -> int:
    """Bands of ``rows`` hashes with which a pair at the threshold is missed with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def least_matches(n_hashes: int, percent: int = PERCENT, miss: float = PRUNE_MISS, step: int = STEP) -> list[tuple[int, int]]:
    """(hashes compared, fewest equal ones with which a pair stays) after each step.

    With m of n hashes equal and a uniform prior the similarity is
    Beta(m + 1, n - m + 1); a pair is pruned when the posterior probability of
    the threshold or more is below ``miss``.  That tail equals the chance of
    at most m successes in n + 1 draws at the threshold.
    """
    t, out = percent / 100, []
    for n in range(step, n_hashes + 1, step):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; one of all words for texts with fewer words."""
    raw, offsets = buffers(texts)
    raw = _LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, _WORD)
    words = word_hashes(raw, starts, ends)
    weights = constants(WORDS, 10)
    n = len(words) - WORDS + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS):
        runs += words[j : j + max(n, 0)] * weights[j]
    runs = mix(runs + np.uint64(WORDS))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            yield np.unique(runs[lo : hi - WORDS + 1])
        elif hi > lo:
            yield mix((words[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
        else:
            yield runs[:0]


def _minima(sets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum of each 32-bit hash function over a set; long sets in blocks."""
    out = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(sets), 1024):
        block = low[None, at : at + 1024] * multipliers[:, :1] + high[None, at : at + 1024] * multipliers[:, 1:]
        np.minimum(out, block.min(1), out=out)
    return out


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, print_1, print_2, signature, band_keys) of every row.

    The two prints identify the set; signature and keys are null for an empty
    set.  The signature holds the low 16 bits of each minimum.
    """
    count = bands()
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("print_1", T.LongType()),
        T.StructField("print_2", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("band_keys", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(constants(count * ROWS * 2, 11)).astype(np.uint32).reshape(-1, 2) | np.uint32(1)
        spread, second = constants(ROWS, 12), constants(1, 13)[0]
        number = mix(np.arange(1, count + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), strings(batch, text_col)
            for lo, hi in slices(buffers(texts)[1]):
                rows = []
                for s in shingles(texts[lo:hi]):
                    if not len(s):
                        rows.append((0, 0, 0, None, None))
                        continue
                    m = _minima(s, seeds)
                    keys = mix((m.reshape(count, ROWS).astype(np.uint64) * spread).sum(1, dtype=np.uint64) ^ number)
                    one, two = s.sum(dtype=np.uint64, keepdims=True), mix(s * second).sum(dtype=np.uint64, keepdims=True)
                    rows.append((len(s), int(one.view(np.int64)[0]), int(two.view(np.int64)[0]), m.astype(np.uint16).tobytes(), keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi], *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                ], names=schema.names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(freeing(run), schema)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that no step of signature comparison prunes."""
    steps = least_matches(bands() * ROWS)
    sig = reps.select("id", "signature")
    joined = pairs.join(sig.withColumnsRenamed({"id": "a", "signature": "s"}), "a").join(sig.withColumnsRenamed({"id": "b", "signature": "t"}), "b")
    kind = reps.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s, t = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(part.num_rows, -1) for k in (2, 3))
                alive, equal, done = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), 0
                for n, least in steps:
                    equal = equal + (s[alive, done:n] == t[alive, done:n]).sum(1)
                    alive, equal, done = alive[equal >= least], equal[equal >= least], n
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return joined.select("a", "b", "s", "t").mapInArrow(freeing(run), schema)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingle hashes, each sorted and distinct, reach the threshold."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, set) of the texts (id, text) of ``ids``."""
    kind = texts.schema["id"].dataType

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = strings(batch, "text")
            for lo, hi in slices(buffers(part)[1]):
                rows = [s.view(np.int64) for s in shingles(part[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(rows, pa.list_(pa.int64()))], names=["id", "set"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("set", T.ArrayType(T.LongType()))])
    return cut(texts.join(cut(ids.distinct()), "id", "left_semi").select("id", "text").mapInArrow(freeing(sets), schema))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; ``texts`` has one (id, text) per representative."""
    kind = texts.schema["id"].dataType
    full = _sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()) for i in range(batch.num_rows)]
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 1)], names=["a", "b"])

    joined = pairs.join(full.withColumnsRenamed({"id": "a", "set": "s"}), "a").join(full.withColumnsRenamed({"id": "b", "set": "t"}), "b")
    return joined.select("a", "b", "s", "t").mapInArrow(freeing(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


class _Bucket:
    """Members of one band bucket that a task compares with the whole bucket as it streams by; its own come first.

    A member is a tuple of arrays: ids, components, signatures and, to confirm
    links, sets and band keys.  A pair is confirmed in the first band it
    shares only.
    """

    def __init__(self, key: tuple, steps: list[tuple[int, int]]):
        self.key, self.steps, self.parts, self.closed = key, steps, [], False

    def add(self, members: tuple, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = int(own.sum())
        if n:
            self.parts.append(tuple(x[:n] for x in members))
        if n < len(own):
            yield from self.close()
            if self.parts:
                yield from self.pairs(tuple(x[n:] for x in members))

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compare the chunk's own members with each other, once all are there."""
        if not self.closed and self.parts:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
            yield from self.pairs(self.parts[0])
        self.closed = True

    def pairs(self, members: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own, other) of different components that no step prunes and, with sets, that reach the threshold."""
        ids, groups, signatures, *exact = self.parts[0]
        width = max(1, (1 << 25) // (STEP * len(ids)))
        for lo in range(0, len(members[0]), width):
            other_ids, other_groups, part, *other_exact = (x[lo : lo + width] for x in members)
            (n, least), *later = self.steps
            equal = (signatures[:, None, :n] == part[None, :, :n]).sum(2)
            # each pair once: the smaller id's chunk has it
            i, j = np.nonzero((equal >= least) & (groups[:, None] != other_groups[None, :]) & (ids[:, None] < other_ids[None, :]))
            equal, done = equal[i, j], n
            for n, least in later:
                equal = equal + (signatures[i, done:n] == part[j, done:n]).sum(1)
                stay, done = equal >= least, n
                i, j, equal = i[stay], j[stay], equal[stay]
            if exact and len(i):
                (sets, keys), (other_sets, other_keys) = exact, other_exact
                stay = (keys[i] == other_keys[j]).argmax(1) == (keys[i] == self.key[0]).argmax(1)
                i, j = i[stay], j[stay]
                stay = np.array([_linked(sets[a], other_sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[stay], j[stay]
            if len(i):
                yield ids[i], other_ids[j]


def _compared(members: DataFrame, reps: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Members (key, id, component) of one bucket compared across components.

    Without ``sets``: the (key, id) of all that a step-by-step comparison of
    signatures leaves with a likely partner.  With ``sets`` (id, set): the
    confirmed links (a, b).  A bucket is compared in chunks of ``CHUNK`` own
    members against the whole bucket streaming by, and candidate pairs never
    leave the task.
    """
    kind, steps, confirm = reps.schema["id"].dataType, least_matches(bands() * ROWS), sets is not None
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    payload = ["signature", "set", "band_keys"] if confirm else ["signature"]
    rows = members.join(sizes, "key").join(reps.join(sets, "id") if confirm else reps, "id")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("own", F.col("chunk") == own)
    dealt = rows.select("key", "chunk", "own", "id", "component", *payload).repartition("key", "chunk")
    dealt = dealt.sortWithinPartitions("key", "chunk", F.col("own").desc())
    names = ["a", "b"] if confirm else ["key", "id"]
    schema = T.StructType([T.StructField(names[0], kind if confirm else T.LongType()), T.StructField(names[1], kind)])

    def lists(column: pa.Array) -> np.ndarray:
        out = np.empty(len(column), object)
        for i in range(len(column)):
            out[i] = column[i].values.to_numpy()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, id_type, near = None, None, set()

        def made(found) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                if confirm:
                    yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), id_type), pa.array(b.tolist(), id_type)], names=names)
                else:
                    near.update(a.tolist())
                    near.update(b.tolist())

        def ended() -> Iterator[pa.RecordBatch]:
            yield from made(bucket.close())
            if near:
                yield pa.RecordBatch.from_arrays([pa.array([bucket.key[0]] * len(near), pa.int64()), pa.array(sorted(near), id_type)], names=names)
                near.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                id_type = batch.column(3).type
                key, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                own, ids, groups = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                columns = (ids, groups, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(batch.num_rows, -1))
                if confirm:
                    columns += (lists(batch.column(6)), np.stack(lists(batch.column(7))))
                cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(chunk) != 0)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if bucket is not None and bucket.key != (key[lo], chunk[lo]):
                        yield from ended()
                        bucket = None
                    bucket = bucket or _Bucket((key[lo], chunk[lo]), steps)
                    yield from made(bucket.add(tuple(x[lo:hi] for x in columns), own[lo:hi]))
        if bucket is not None:
            yield from ended()

    return dealt.mapInArrow(freeing(run), schema)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``df``.

    A document's set are its distinct shingles of five words; documents with
    100 * intersection >= 75 * union are linked, and a component is what links
    reach.  ``component_id`` is the smallest id in it, ``kept`` says that the
    row's id is that one.

    Rows with equal sets are one class, whose smallest id stands for it.
    Classes that share a band are candidates.  First every class meets the
    smallest class of each of its bands; then the members of bands that still
    hold several components meet the members of the other components, block by
    block inside the tasks.  So a large group of copies costs one pair per
    copy, and every candidate pair that could still join two components is
    looked at.  Candidates pass the sequential test on signatures and then the
    exact one on full sets; of the second kind only links leave a task.  A link at the threshold
    is missed with chance ``BAND_MISS`` plus ``PRUNE_MISS`` per step at most.

    Texts without words, and null texts, have an empty set and are linked with
    nothing.  Rows with one id are one document, linked through all their
    texts.  A null id is in no component (null) and kept.  An empty table
    gives no rows; other columns are ignored.
    """
    sig = cut(signatures(df, id_col, text_col))
    full = sig.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "print_1", "print_2"]
    one = full.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("band_keys").alias("band_keys"))
    copied = one.where("rep < last").select("rep", *key)
    same = cut(full.select("id", *key).join(copied, key).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    posts = one.select(F.col("rep").alias("id"), F.explode("band_keys").alias("key"))
    heads = posts.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    posts = cut(posts.join(cut(heads), "key").distinct())
    reps = cut(full.join(cut(posts.select("id").distinct()), "id", "left_semi").select("id", "signature", "band_keys").distinct())
    first = cut(_ordered(posts.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    links = cut(_confirmed(cut(_likely(first, reps)), texts))
    edges = same.unionByName(links)
    groups = components(edges)
    placed = posts.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_keys = cut(placed.join(cut(mixed), "key", "left_semi").select("key", "id", "component"))
    open_keys = cut(open_keys.join(_compared(open_keys, reps).distinct(), ["key", "id"], "left_semi"))
    more = cut(_compared(open_keys, reps, _sets(open_keys.select("id"), texts)))
    final = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = sig.select("id", "n_shingles").join(final, "id", "left")
    component = F.coalesce("component", "id")
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its own columns, that stand for their group; of rows with one id the first by text."""
    found = near_duplicates(df, id_col, text_col)
    other, row = free_name(df, "_other_id"), free_name(df, "_row")
    gone = cut(found.where(~F.col("kept")).select(F.col(id_col).alias(other)).distinct())
    kept = df.join(gone, F.col(id_col) == F.col(other), "left_anti")
    again = cut(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias(other)))
    once = kept.join(again, F.col(id_col) == F.col(other), "left_anti")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    repeated = kept.join(again, F.col(id_col) == F.col(other), "left_semi").withColumn(row, F.row_number().over(order))
    return once.unionByName(repeated.where(F.col(row) == 1).drop(row))
