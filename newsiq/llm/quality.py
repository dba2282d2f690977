"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Rows are ranked on the scale of a passage, not of the whole text: by the
lightest passage of words, or by the mean of all n-grams where that is the
worse of the two.  So a long text cannot make up for a passage by its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsiq.llm.batches import buffers, cut, free_name, freeing, set_aside, slices, strings, with_columns
from newsiq.llm.hashing import constants, mix, word_hashes

#: Buckets of the hashed n-grams: the power of two that is not below the number of distinct ones, from
#: ``BUCKETS`` to ``MOST_BUCKETS``, which bounds what the driver and each task hold. Half are for words.
BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 21
#: Labelled rows that the target model is fitted on, at most; it bounds the broadcast table of labels.
LABELLED = 1 << 16
#: Added to every bucket of both models.
PRIOR = 1.0
#: Share of the labelled target rows that the number of rows to keep is set by.
RECALL = 0.999
#: Room below the lightest of them, on the scale of a passage: few Gumbel draws are below -1.
ROOM = 1.0
#: Words of a passage.
PASSAGE = 32

_PAIR = constants(2, 5)
_WORDS = r"([^\p{L}\p{N}\s]+)"


@dataclass
class Model:
    """Log-ratio of the target and the raw probability per bucket, and the counts it is from.

    ``usual`` is the target's mean log-ratio of a word and of a bigram, each
    n-gram weighed without its own occurrence in the target.  ``low`` is the lightest passage
    and the lightest mean that target rows have, None without a target.
    """

    log_ratio: np.ndarray
    target: np.ndarray
    raw: np.ndarray
    prior: float = PRIOR
    usual: tuple[float, float] = (0.0, 0.0)
    low: tuple[float, float] | None = None


def _spaced(texts: pa.Array) -> pa.Array:
    """Lower-case texts in which runs of signs stand apart."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), _WORDS, r" \1 ")


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets of all uni- and bigrams, row of each, how many of them are unigrams), unigrams first, both in order."""
    lists = pc.utf8_split_whitespace(_spaced(texts))
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    raw, offsets = buffers(coded.dictionary)
    each = word_hashes(raw, offsets[:-1], offsets[1:])
    codes = coded.indices.to_numpy()
    words, row = each[codes], np.repeat(np.arange(len(texts)), np.diff(ends))
    real = np.diff(offsets)[codes] > 0
    pair = np.flatnonzero((row[1:] == row[:-1]) & real[1:] & real[:-1])
    bigrams = mix(words[pair] * _PAIR[0] + words[pair + 1] * _PAIR[1])
    half = buckets // 2
    of = np.concatenate([words[real] % np.uint64(half), bigrams % np.uint64(half) + np.uint64(half)])
    return of.astype(np.int64), np.concatenate([row[real], row[pair]]), int(real.sum())


def _parts(each: np.ndarray, row: np.ndarray, n_words: int, n: int, usual: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(lightest passage, mean) of ``n`` rows from the log-ratios of their n-grams; 0 where there is none.

    The lightest passage is the smallest sum over at most ``PASSAGE`` words in
    a row, the mean is over all n-grams, or over as many as a passage has in
    shorter texts; every n-gram counts by what it has more than ``usual``.
    Values are multiples of 2**-24, so sums are exact in any order.
    """
    each = np.round((each - np.repeat(usual, [n_words, len(each) - n_words])) * 2.0**24) / 2.0**24
    mean = np.bincount(row, each, n) / np.maximum(np.bincount(row, minlength=n), 2 * PASSAGE)
    words, lightest = row[:n_words], np.zeros(n)
    first, has = np.searchsorted(words, np.arange(n)), np.bincount(words, minlength=n) > 0
    sums, at = np.concatenate([[0.0], np.cumsum(each[:n_words])]), np.arange(n_words)
    if n_words:
        lightest[has] = np.minimum.reduceat(sums[at + 1] - sums[np.maximum(at - PASSAGE + 1, first[words])], first[has])
    return lightest, mean


def _passage(lightest: np.ndarray, mean: np.ndarray, low: tuple[float, float] | None) -> np.ndarray:
    """The lightest passage, or the mean where it is worse, stretched so that its ``low`` is that of the passages."""
    if low is None or max(low) >= 0:
        return lightest
    return np.minimum(lightest, mean * (low[0] / low[1]))


def sample_labels(labels: DataFrame, id_col: str = "doc_id", most: int = LABELLED, seed: int = 5) -> DataFrame:
    """(id, is_target) of at most ``most`` labelled ids, those with the smallest hashes.

    An id is target when all its labels say quality 1 and none says toxic; a
    null quality makes it no target.  Null ids have no label.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        (F.min(F.coalesce("quality", F.lit(0))) == 1).alias("q"), (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("t")
    )
    one = one.select(F.col(id_col).alias("_label_id"), (F.col("q") & F.col("t")).alias("_is_target"))
    return one.orderBy(F.xxhash64(F.lit(seed), "_label_id"), "_label_id").limit(most)


def _marked(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    return df.join(F.broadcast(sample), F.col(id_col) == F.col("_label_id"), "left")  # at most LABELLED rows of 9 bytes


def fit(df: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None, prior: float = PRIOR) -> Model:
    """Bucket models of the target rows (labelled sample) and of the raw rows (all of ``df``).

    Every task adds up its buckets; only those sums are shuffled, and at most
    ``MOST_BUCKETS`` of them reach the driver.  There they are folded to
    ``buckets``, by default as many as the distinct n-grams ask for.  Without
    target rows, or without any row, all log-ratios are 0.
    """
    most = MOST_BUCKETS
    rows = _marked(df.select(id_col, text_col), sample, id_col)
    rows = rows.select(F.coalesce("_is_target", F.lit(False)).alias("target"), F.col(text_col).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(most, np.int32), np.zeros(most, np.int32)
        for batch in batches:
            texts, flags = strings(batch, "words"), batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(buffers(texts)[1]):
                of, row, _ = _features(texts[lo:hi], most)
                for sums, seen in ((raw, of), (target, of[flags[lo:hi][row]])):  # a slice has far fewer n-grams than there are buckets
                    bucket, n = np.unique(seen, return_counts=True)
                    sums[bucket] += n.astype(np.int32)
        used = np.flatnonzero(raw)
        for lo in range(0, len(used), 1 << 16):
            at = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(target[at].astype(float)), pa.array(raw[at].astype(float))], names=["bucket", "target", "raw"])

    sums = rows.mapInArrow(freeing(run), "bucket int, target double, raw double").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    table = sums.toArrow()  # at most one row a bucket
    target, raw = np.zeros(most), np.zeros(most)
    target[table["bucket"].to_numpy()], raw[table["bucket"].to_numpy()] = table["target"].to_numpy(), table["raw"].to_numpy()
    if buckets is None:
        empty = (raw.reshape(2, -1) == 0).sum(1)
        distinct = float((most / 2 * np.log(most / 2 / np.maximum(empty, 1))).sum())  # n-grams that share a bucket counted in
        buckets = BUCKETS
        while buckets < min(distinct, most):
            buckets *= 2
    target, raw = (x.reshape(2, -1, buckets // 2).sum(1).ravel() for x in (target, raw))
    if not target.sum():
        return Model(np.zeros(buckets), target, raw, prior)
    p, q = target + prior, raw + prior
    own = np.where(target > 0, np.log(np.maximum(p - 1, prior)) - np.log(q) + np.log(q.sum()) - np.log(p.sum()), 0.0)
    usual = [float((t * o).sum() / max(t.sum(), 1.0)) for t, o in zip(target.reshape(2, -1), own.reshape(2, -1), strict=True)]
    return Model(np.log(p / p.sum()) - np.log(q / q.sum()), target, raw, prior, tuple(usual))


def weigh(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", seed: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``log_weight``, ``passage`` and ``gumbel`` double and ``rank_key`` long.

    ``log_weight`` is the log of target over raw probability of the whole
    text, to six decimals, ``passage`` the same on the scale of a passage, see
    :func:`_passage`; a null or empty text has 0.  ``gumbel`` is drawn from a
    hash of seed and id, so it is the same in every run and for every row of an
    id.  ``rank_key`` orders rows as the sum of ``passage`` and ``gumbel`` does.
    """
    shared, usual, low = df.sparkSession.sparkContext.broadcast(model.log_ratio), model.usual, model.low
    drawn = free_name(df, "_draw")

    def run(batch: pa.RecordBatch) -> list:
        ratio = shared.value
        texts = strings(batch, text_col)
        weight, passage = np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in slices(buffers(texts)[1]):
            of, row, n_words = _features(texts[lo:hi], len(ratio))
            each = ratio[of]
            weight[lo:hi] = np.bincount(row, each, hi - lo)
            passage[lo:hi] = _passage(*_parts(each, row, n_words, hi - lo, usual), low)
        weight = np.round(weight, 6) + 0.0
        draw = batch.column(batch.schema.get_field_index(drawn)).to_numpy()
        unit = ((draw.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        gumbel = -np.log(-np.log(unit))
        bits = (passage + gumbel + 0.0).view(np.int64)
        return [pa.array(weight), pa.array(passage), pa.array(gumbel), pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))]

    stay = list(df.columns if keep is None else keep)
    needed = list(dict.fromkeys([*stay, id_col, text_col]))
    rows = df.select(*needed).withColumn(drawn, F.xxhash64(F.lit(seed), F.col(id_col)))
    return with_columns(rows, "log_weight double, passage double, gumbel double, rank_key long", run, stay, by=text_col)


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The ``k``-th largest value of a long column, None when ``k`` is 0 or there is no row.

    Four counting passes of sixteen bits each; a pass brings at most 65536
    counts to the driver, whatever the number of rows.
    """
    if k <= 0:
        return None
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = df if prefix is None else df.where(F.shiftright(key, shift + 16) == prefix)
        counts = rows.groupBy(F.shiftright(key, shift).alias("p")).count().orderBy(F.desc("p")).collect()
        for row in counts:
            if k <= row["count"]:
                prefix = row["p"]
                break
            k -= row["count"]
        else:
            return None
    return prefix


def lows(df: DataFrame, model: Model, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", recall: float = RECALL) -> tuple[float, float] | None:
    """Lightest passage and lightest mean of the ``recall`` best of the labelled target rows, each for itself; None without any.

    Each is weighed without its own n-grams in the target, as it would be
    without a label.
    """
    sc, usual, prior = df.sparkSession.sparkContext, model.usual, model.prior
    shared = sc.broadcast((model.target, model.raw))
    rows = df.select(id_col, text_col).join(F.broadcast(sample.where("_is_target")), F.col(id_col) == F.col("_label_id"), "left_semi").select(F.col(text_col).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = shared.value
        level = np.log((raw + prior).sum()) - np.log((target + prior).sum())
        for batch in batches:
            texts = strings(batch, "words")
            for lo, hi in slices(buffers(texts)[1]):
                of, row, n_words = _features(texts[lo:hi], len(raw))
                _, back, own = np.unique(row * len(raw) + of, return_inverse=True, return_counts=True)
                own = own[back]
                each = np.log(np.maximum(target[of] - own, 0) + prior) - np.log(raw[of] + prior) + level
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _parts(each, row, n_words, hi - lo, usual)], names=["lightest", "mean"])

    found = rows.mapInArrow(freeing(run), "lightest double, mean double").agg(*[F.expr(f"percentile_approx({c}, {1 - recall}, 100000)") for c in ("lightest", "mean")]).first()
    return None if found[0] is None else tuple(found)


@dataclass
class Selection:
    """A fitted model, the weighed rows of the table it was fitted on, and the key of the last row kept."""

    model: Model
    weighed: DataFrame
    k: int
    last_key: int | None


def select(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int | None = None, seed: int = 5) -> Selection:
    """Importance resampling of ``k`` rows of ``df`` without replacement.

    The target is the labelled sample's text of quality, the raw text all of
    ``df``.  The ``k`` rows with the largest ``passage`` plus Gumbel draw are
    kept; without ``k`` it is the number of rows not below :func:`lows`, less
    ``ROOM``.  Rows whose keys equal the last one's, such as repeated rows, are
    all kept.
    """
    sample = sample_labels(labels, id_col)
    model = fit(df, sample, text_col, id_col)
    model.low = lows(df, model, sample, text_col, id_col)
    weighed = cut(weigh(df, model, text_col, id_col, seed, keep=[id_col]))
    if k is None:
        k = weighed.count() if model.low is None else weighed.where(F.col("passage") >= model.low[0] - ROOM).count()
    return Selection(model, weighed, k, kth_largest(weighed, "rank_key", k))


def keep_selected(df: DataFrame, chosen: Selection, text_col: str = "text", id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """The rows of ``df``, with its own columns, that the selection keeps."""
    names = df.columns
    plain, own = set_aside(df, ("log_weight", "passage", "gumbel", "rank_key"))
    rows = weigh(plain, chosen.model, text_col, id_col, seed)
    rows = rows.where(F.col("rank_key") >= chosen.last_key) if chosen.last_key is not None else rows.where(F.lit(False))
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in names])
