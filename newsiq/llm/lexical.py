"""Ranked lexical search: term-at-a-time over the blocks of an inverted index, with a limited set of accumulators.

The index holds one row per block of texts: the ids and lengths of the block's
texts and, per term, its posting list.  A block answers an item by taking the
item's terms rarest first.  A term opens accumulators for texts that have none
as long as a text without any could still come among the best k; from then on
the terms that are left only update the accumulators that exist, so that their
scores are exact.  The best k of all blocks are ranked in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import buffers, cut, freeing, slices, strings
from newsiq.llm.hashing import word_hashes, word_spans

#: Text bytes of a block, and items' terms that a task holds at once.
BLOCK_BYTES, PACK_TERMS = 1 << 22, 1 << 19
#: Parts of an item's partial results that are ranked before the whole.
PARTS = 64

_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hash of each occurrence, text number of each) of a slice of texts, found in smaller ones."""
    terms, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(buffers(texts)[1]):
        raw, offsets = buffers(texts[lo:hi])
        raw = _LOWER[raw]
        starts, ends, first = word_spans(raw, offsets, _TERM)
        if len(starts):
            terms.append(word_hashes(raw, starts, ends))
            rows.append(np.repeat(np.arange(lo, hi), np.diff(np.append(first[:-1], len(starts)))))
    return np.concatenate(terms).view(np.int64), np.concatenate(rows)


def _counted(terms: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, times) of the distinct pairs, by term and row."""
    order = np.lexsort((row, terms))
    terms, row = terms[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])])) if len(terms) else np.zeros(0, np.int64)
    return terms[new], row[new], np.diff(np.append(new, len(terms)))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, ids, lengths, terms, dfs, rows, tfs): posting lists of every whole text, a row per block.

    A term is a maximal run of ASCII letters and digits and of characters
    beyond ASCII, A-Z lower-cased, and stands as a 64-bit hash.  ``terms`` is
    sorted; its i-th entry has the next ``dfs[i]`` of the postings ``rows``
    (text number in the block) and ``tfs``.  Texts lie in a block by id.

    Texts that are null or have no term are in no block, so an empty table
    gives no row.  Repeated rows and null ids are texts of their own.  A text
    longer than a block is a block alone.  Other columns are ignored.
    """
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("lengths", T.ArrayType(T.LongType())),
        *[T.StructField(n, T.ArrayType(t)) for n, t in (("terms", T.LongType()), ("dfs", T.IntegerType()), ("rows", T.IntegerType()), ("tfs", T.IntegerType()))],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), strings(batch, batch.schema.names[1])
            order = pc.sort_indices(ids, null_placement="at_start")
            sizes = np.diff(buffers(texts)[1])[order.to_numpy()]
            for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)]), BLOCK_BYTES):
                here = order[lo:hi]
                terms, row = _terms(texts.take(here))
                lengths = np.bincount(row, minlength=hi - lo)
                place = np.cumsum(lengths > 0) - 1
                terms, row, tfs = _counted(terms, place[row])
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                each, dfs = np.unique(terms, return_counts=True)
                lists = [ids.take(here.take(pa.array(some))), pa.array(lengths[some], pa.int64()), pa.array(each), *[pa.array(x, pa.int32()) for x in (dfs, row, tfs)]]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=schema.names)
                made += 1
            del batch, ids, texts  # before the next one is read

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), schema)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): the terms of each distinct item."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[id_col].dataType), T.StructField("term", T.LongType()), T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, "text")
            for lo, hi in slices(buffers(texts)[1]):
                terms, row, times = _counted(*_terms(texts[lo:hi]))
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(terms), pa.array(times, pa.int64())], names=schema.names)

    one = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return one.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(run, schema)


def best_of_block(weights: list[np.ndarray], bounds: list[int], postings: list[np.ndarray], n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, scores) of a block's texts that may be among the best ``k``.

    Terms come rarest first: ``weights[i]`` is what term i gives to each text
    of ``postings[i]``, ``bounds[i]`` the most of it.  ``floor`` is a score
    that k texts elsewhere are known to reach.  All texts that reach both
    ``floor`` and the block's k-th score are returned, so ties are whole.
    """
    scores, left, alive = np.zeros(n, np.int64), sum(bounds), None
    for gains, rows, bound in zip(weights, postings, bounds, strict=True):
        if alive is None and left < max(floor, np.partition(scores, n - k)[n - k] if n >= k else 0):
            alive = scores > 0
        if alive is None:
            scores[rows] += gains
        else:
            on = alive[rows]
            scores[rows[on]] += gains[on]
        left -= bound
    least = max(1, floor, np.partition(scores, n - k)[n - k] if n >= k else 0)
    at = np.flatnonzero(scores >= least)
    return at, scores[at]


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", out_id: str = "doc_id") -> DataFrame:
    """(item_id, rank, id, score): the ``k`` best texts of ``index`` for each item, scores above 0, equal ones by id.

    With N texts, L occurrences of terms in all, and for a term of df texts
    the weight w = floor(1000 ln((2N + 2) / (2 df + 1))), a text of n terms
    that has the term tf times gains w * ((10^9 tf) div (1000 tf + 12 m)),
    m = 75 + (25 n N) div L, for each time the item holds the term.

    ``index`` should be stored, a block by itself (``cut`` with ``at_once=1``),
    since blocks have megabytes; it is read for the document frequencies and
    once per pack of about ``PACK_TERMS`` items' terms, which go to all tasks.
    A block ships its best k at most (and ties), less what the task has seen
    beaten; an item's rows are ranked in parts first, so no task gets all.

    Items that are null, or whose terms no text has, give no row.  Rows of
    equal id and text are one item; of equal id and different text each is
    ranked by itself.  Null ids are ids, repeated texts rank side by side.
    """
    total = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_texts, n_terms = total.n or 0, total.l or 0
    wanted = cut(_item_terms(items, id_col, text_col))
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = held.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_texts + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = cut(wanted.join(df, "term").select("item", "item_id", "term", "times", "df", weight.alias("w")))
    packs = max(1, -(-weighed.count() // PACK_TERMS))
    parts = [_scored(index, weighed.where(F.pmod("item", F.lit(packs)) == p), k, n_texts, n_terms, out_id) for p in range(packs)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    order = [F.desc("score"), F.asc_nulls_first(out_id)]
    part = F.pmod(F.xxhash64(out_id), F.lit(PARTS))
    some = found.withColumn("_rank", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).where(F.col("_rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item_id").alias(id_col), "rank", out_id, "score")


def _scored(index: DataFrame, weighed: DataFrame, k: int, n_texts: int, n_terms: int, out_id: str) -> DataFrame:
    """(item, item_id, id, score): what the blocks of ``index`` hold against one pack of items."""
    schema = T.StructType([
        T.StructField("item", T.LongType()), weighed.schema["item_id"],
        T.StructField(out_id, index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType()),
    ])
    shared = index.sparkSession.sparkContext.broadcast(weighed.orderBy("item", "df", "term").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = shared.value
        item, term, times, w = (pack.column(c).to_numpy() for c in ("item", "term", "times", "w"))
        asked, which = np.unique(term, return_inverse=True)
        edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, np.int64)
        tops = [np.zeros(0, np.int64) for _ in edges[:-1]]
        for batch in batches:
            for b in range(batch.num_rows):
                ids, lengths, terms, dfs, rows, tfs = (batch.column(c)[b].values for c in range(1, 7))
                n, ends = len(ids), np.cumsum(dfs.to_numpy(), dtype=np.int64)
                m = 75 + 25 * lengths.to_numpy() * n_texts // n_terms
                at = np.searchsorted(terms.to_numpy(), asked)
                has = np.flatnonzero((at < len(terms)) & (terms.to_numpy()[np.minimum(at, len(terms) - 1)] == asked))
                gains, postings, most = [None] * len(asked), [None] * len(asked), np.zeros(len(asked), np.int64)
                rows, tfs = rows.to_numpy(), tfs.to_numpy()
                for i in has:
                    lo, hi = ends[at[i]] - dfs[int(at[i])].as_py(), ends[at[i]]
                    tf = tfs[lo:hi].astype(np.int64)
                    postings[i] = rows[lo:hi]
                    gains[i] = 1_000_000_000 * tf // (1000 * tf + 12 * m[postings[i]])
                    most[i] = gains[i].max()
                for q, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    here = [(j, which[j]) for j in range(a, z) if gains[which[j]] is not None and w[j] > 0]
                    if not here:
                        continue
                    floor = int(tops[q].min()) if len(tops[q]) == k else 0
                    factor = [int(w[j] * times[j]) for j, _ in here]
                    found, scores = best_of_block(
                        [gains[i] * f for (_, i), f in zip(here, factor, strict=True)], [int(most[i]) * f for (_, i), f in zip(here, factor, strict=True)],
                        [postings[i] for _, i in here], n, k, floor,
                    )
                    if not len(found):
                        continue
                    tops[q] = np.sort(np.concatenate([tops[q], scores]))[-k:]
                    order = np.lexsort((found, -scores))[:k]  # texts of a block lie by id
                    take = pa.array(np.full(len(order), a))
                    yield pa.RecordBatch.from_arrays([pa.array(item).take(take), pack.column("item_id").combine_chunks().take(take), ids.take(pa.array(found[order])), pa.array(scores[order])], names=schema.names)

            del batch

    return index.mapInArrow(freeing(run), schema)
