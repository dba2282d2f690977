"""Exact nearest-neighbour join of a query table against a vector table.

Scores are cosine similarities in double precision.  Both sides are packed
into blocks of rows where they lie; every corpus block meets every query block
as one matrix product, and a task keeps only the best ``k`` rows per query, so
no pair that cannot win leaves a task.  The corpus is never shuffled.  The
packed queries are the one small side: the adaptive planner sends them to all
tasks when their measured size is below its broadcast bound, and reads them
block by block otherwise; the plan is the same for every size and nothing runs
while it is built.

Scores are ranked after rounding to 9 decimals and ties go to the smaller id,
which makes the order independent of batch and partition boundaries.  Ids may
be integers or strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.operators.windows import top_per

BLOCK_QUERIES = 1024
BLOCK_ROWS = 8192
#: Query blocks whose running best a task holds at a time; a best is k ids and scores a query.
HELD = 1024
DIGITS = 9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a unit-length double matrix; zero vectors stay zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(array)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of one table must have one length")
    m = flat.reshape(n, -1) if n else np.zeros((0, 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def values(array: pa.Array) -> np.ndarray:
    """An id column as sortable numpy values: integers, or strings by code point."""
    if pa.types.is_integer(array.type):
        return array.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(array.to_pylist(), dtype=str)


class Best:
    """Running best ``k`` rows per query, ordered by (score desc, id).

    ``extra`` columns travel with the ids.
    """

    def __init__(self, queries: int, k: int, extra: int = 0):
        self.k = k
        self.x: list[np.ndarray | None] = [None] * extra
        self.q = np.zeros(0, dtype=np.int64)
        self.s = np.zeros(0)
        self.i: np.ndarray | None = None
        self.floor = np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, extra: list[np.ndarray] | None = None) -> None:
        """``scores`` is (rows, queries); ``extra`` has one value per row and column."""
        n, k = scores.shape[0], self.k
        if n == 0:
            return
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[order]
        extra = [e[order] for e in extra or []]
        floor = self.floor
        if n > k:
            floor = np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k])
        rows, cols = np.nonzero(scores >= floor)
        # rows are in id order, so of the rows tied at the floor the first k do
        tied = scores[rows, cols] == floor[cols]
        if tied.sum() > 2 * k * len(floor):
            pos = np.lexsort((rows, cols))
            rows, cols, tied = rows[pos], cols[pos], tied[pos]
            start = np.searchsorted(cols, cols)
            seen = np.cumsum(tied) - tied
            keep = ~tied | (seen - seen[start] < k)
            rows, cols = rows[keep], cols[keep]
        q = np.concatenate([self.q, cols])
        s = np.concatenate([self.s, scores[rows, cols]])
        more = lambda old, new: new if old is None else np.concatenate([old, new])
        i, x = more(self.i, ids[rows]), [more(old, e[rows]) for old, e in zip(self.x, extra, strict=True)]
        pos = np.lexsort((i, -s, q))
        q, s, i, x = q[pos], s[pos], i[pos], [e[pos] for e in x]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        self.q, self.s, self.i, self.x = q[keep], s[keep], i[keep], [e[keep] for e in x]
        full = rank[keep] == k - 1
        self.floor[self.q[full]] = self.s[full]


def batch_of(ids: np.ndarray, best: Best, names: list[str]) -> pa.RecordBatch:
    columns = [ids[best.q], ids[:0] if best.i is None else best.i, best.s, *[np.zeros(0, np.int64) if x is None else x for x in best.x]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _key_type(df: DataFrame, column: str) -> T.DataType:
    """Type under which an id column travels: integers as long, anything else as string."""
    return T.LongType() if isinstance(df.schema[column].dataType, T.IntegralType) else T.StringType()


def _packed(df: DataFrame, keys: list[str], vec: str, rows: int, prefix: str) -> DataFrame:
    """Blocks of at most ``rows`` rows of a partition: a list per key column, and the unit vectors end to end."""
    kinds = [_key_type(df, c) for c in keys]
    taken = df.where(F.col(vec).isNotNull()).select(*[F.col(c).cast(t).alias(f"{prefix}{i}") for i, (c, t) in enumerate(zip(keys, kinds, strict=True))], F.col(vec).alias("vec"))
    schema = T.StructType([T.StructField(f"{prefix}{i}", T.ArrayType(t)) for i, t in enumerate(kinds)] + [T.StructField(f"{prefix}vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                lists = [pa.array([part.column(j).to_pylist()], pa.list_(part.column(j).type)) for j in range(len(keys))]
                flat = _matrix(part.column(len(keys))).ravel()
                yield pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=schema.names)

    return taken.mapInArrow(run, schema)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "query_id",
    query_vec: str = "query_embedding",
    id_col: str = "id",
    vec: str = "embedding",
    block_queries: int = BLOCK_QUERIES,
    block_rows: int = BLOCK_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """(query, id, score, rank) of the ``k`` most similar corpus rows of every query.

    Query keys, corpus ids and ``carry`` columns are integers or strings; the
    latter come along with the winners, which saves a join back to the corpus.
    Vectors may be NULL and are skipped then.  ``k`` is at least 1.
    """
    k, carry = max(int(k), 1), carry or []
    # the exchange lets the adaptive planner see the size; of one partition, so that a product reads the corpus once
    q = _packed(queries, [query_key], query_vec, block_queries, "_q").repartition(1)
    c = _packed(corpus, [id_col, *carry], vec, block_rows, "_c")
    fields = [T.StructField(query_key, _key_type(queries, query_key)), T.StructField(id_col, _key_type(corpus, id_col)), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [T.StructField(x, _key_type(corpus, x)) for x in carry])
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in schema]
    names, width = schema.names, len(carry)

    def scan(batches):
        held: dict[tuple, tuple[np.ndarray, Best]] = {}

        def out(keys: np.ndarray, best: Best) -> pa.RecordBatch:
            found = batch_of(keys, best, names)
            return pa.RecordBatch.from_arrays([found.column(j).cast(t) for j, t in enumerate(kinds)], names=names)

        for batch in batches:
            for r in range(batch.num_rows):
                cells = [batch.column(j)[r].values for j in range(batch.num_columns)]
                ids, extra, rows, keys = values(cells[0]), [values(x) for x in cells[1 : 1 + width]], cells[1 + width], cells[2 + width]
                block = (len(keys), keys[0].as_py(), keys[-1].as_py())
                if block not in held:
                    if len(held) >= HELD:
                        yield out(*held.pop(next(iter(held))))  # the block met longest ago comes last again
                    held[block] = (values(keys), Best(len(keys), k, width))
                _, best = held[block] = held.pop(block)
                matrix = cells[3 + width].to_numpy().reshape(len(keys), -1).T
                vectors = rows.to_numpy().reshape(len(ids), -1)
                for lo in range(0, len(ids), 1024):
                    best.add(ids[lo : lo + 1024], np.round(vectors[lo : lo + 1024] @ matrix, DIGITS), [x[lo : lo + 1024] for x in extra])
        for keys, best in held.values():
            if len(best.q):
                yield out(keys, best)

    best = c.crossJoin(q).mapInArrow(scan, schema)
    order = [F.col("score").desc(), F.col(id_col)]
    return top_per(best, [query_key], order, k, "rank")
