"""Stored index of a vector table: cells with a centroid and a radius, searched with bounds.

Unit vectors are dealt to cells of spherical k-means, whose centroids are
fitted on a bounded sample; every vector is indexed.  A stored row is a block
of one cell's vectors with the centroid and the largest angle to it, so no
vector of the block can be closer to a query than the query's angle to the
centroid less that radius.  A search reads every block once and multiplies
only the queries whose bound can still reach their k-th best score; blocks
are near each other on disk by cell, and a task meets the nearest ones of its
part first.  With ``probes`` each query looks into so many cells only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.operators.knn import DIGITS, Best, _key_type, _matrix, batch_of, values
from newsiq.operators.lineage import cut
from newsiq.operators.windows import top_per

#: Vectors that centroids are fitted on, at most, and rounds of fitting; more cells than ``MOST_CELLS`` are not made.
SAMPLE, ROUNDS, MOST_CELLS = 1 << 15, 8, 1 << 12
#: Vectors of a stored block and of a query block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Parts of a cell when its vectors are dealt out.
SALTS = 16
#: Added to a bound on a cosine, which is rounded to ``DIGITS``.
_SLACK = 1e-8


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids of spherical k-means over unit vectors; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[lo : lo + 4096] @ centroids.T, axis=1) for lo in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def build(corpus: DataFrame, id_col: str = "id", vec: str = "embedding", carry: list[str] | None = None, cells: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The index of all non-null vectors of ``corpus``, written to the shared folder.

    ``cells`` defaults to the square root of the number of vectors, at most
    ``MOST_CELLS``.  A cell may hold any share of the table: its vectors are
    dealt to salted parts, and each part packs its own blocks.  Ids and
    ``carry`` are integers or strings.
    """
    carry = carry or []
    kinds = [_key_type(corpus, c) for c in [id_col, *carry]]
    rows = corpus.where(F.col(vec).isNotNull()).select(*[F.col(c).cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip([id_col, *carry], kinds, strict=True))], F.col(vec).alias("vec"))
    total = rows.count()
    wanted = cells or min(MOST_CELLS, max(1, int(total**0.5)))
    picked = rows.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(sample).select("vec").toArrow()  # bounded
    unit = _matrix(picked.column(0)) if picked.num_rows else np.zeros((0, 0))
    centroids = fit_cells(unit, wanted) if len(unit) else np.zeros((0, 0))
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)
    dealt = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("salt", T.IntegerType()), *rows.schema.fields[:-1], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def deal(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                m = _matrix(part.column(len(kinds)))
                cell = np.argmax(m @ shared.value.T, axis=1).astype(np.int32)
                salt = (np.arange(len(cell)) * 31 + lo) % SALTS
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(salt, pa.int32()), *part.columns[:-1], flat], names=dealt.names)

    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()), T.StructField("centroid", T.ArrayType(T.DoubleType())),
        *[T.StructField(f"k{i}", T.ArrayType(t)) for i, t in enumerate(kinds)], T.StructField("vecs", T.ArrayType(T.DoubleType())),
    ])

    def pack(batches):
        def block(cell: int, columns: list[pa.Array], m: np.ndarray) -> pa.RecordBatch:
            centre = shared.value[cell]
            radius = float(np.arccos(np.clip((m @ centre).min(), -1.0, 1.0)))
            lists = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in columns]
            arrays = [pa.array([cell], pa.int32()), pa.array([radius]), pa.array([centre]), *lists, pa.array([m.ravel()])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:  # by cell
            cell = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                for lo in range(a, z, BLOCK_ROWS):
                    part = batch.slice(lo, min(BLOCK_ROWS, z - lo))
                    yield block(int(cell[lo]), part.columns[2:-1], part.column(part.num_columns - 1).flatten().to_numpy().reshape(part.num_rows, -1))

    by_cell = rows.mapInArrow(deal, dealt).repartition("cell", "salt").sortWithinPartitions("cell")
    out = cut(by_cell.mapInArrow(pack, schema))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate([id_col, *carry])})


def _centres(index: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells, their centroids), at most ``MOST_CELLS``."""
    found = index.groupBy("cell").agg(F.first("centroid").alias("centroid")).orderBy("cell").toArrow()
    return found.column("cell").to_numpy(), _matrix(found.column("centroid"))


def _nearest(queries: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cells of each query, nearest first."""
    return centres[0][np.argsort(-(queries @ centres[1].T), axis=1, kind="stable")].astype(np.int32)


def probes_for(index: DataFrame, queries: DataFrame, k: int, recall: float = 0.9, query_key: str = "query_id", query_vec: str = "query_embedding") -> int:
    """The fewest cells a query must look into so that ``recall`` of the exact search's rows are in them.

    Measured on all ``queries`` against all indexed vectors; at least 1.
    """
    kind, centres = _key_type(queries, query_key), _centres(index)
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_key).cast(kind).alias("q"), F.col(query_vec).alias("vec"))

    def order(batches):
        for batch in batches:
            near = [pa.array(row) for row in _nearest(_matrix(batch.column(1)), centres)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.to_pylist() for x in near], pa.list_(pa.int32()))], names=["q", "near"])

    near = asked.mapInArrow(order, T.StructType([T.StructField("q", kind), T.StructField("near", T.ArrayType(T.IntegerType()))]))
    truth = search(index, queries, k, query_key, query_vec, cells=True).select(F.col(query_key).alias("q"), F.col("cell").cast("int").alias("cell"))
    places = truth.join(near, "q").groupBy(F.array_position("near", F.col("cell")).alias("place")).count().orderBy("place").collect()  # a row a cell at most
    left = recall * sum(r["count"] for r in places)
    for r in places:
        left -= r["count"]
        if left <= 0:
            return int(r.place)
    return 1


def search(
    index: DataFrame, queries: DataFrame, k: int, query_key: str = "query_id", query_vec: str = "query_embedding", probes: int | None = None, block_queries: int = BLOCK_QUERIES, cells: bool = False
) -> DataFrame:
    """(query, id, score, rank, carried columns, with ``cells`` also the cell) of the ``k`` most similar indexed vectors of every query.

    Exact without ``probes``: scores, order and ties are those of
    :func:`newsiq.operators.knn.knn_join`.  With ``probes`` a query meets the
    blocks of its so many nearest cells, and results may be missed.
    """
    k = max(int(k), 1)
    ids = [c for c in index.columns if c not in ("cell", "radius", "centroid", "vecs")]
    kind = _key_type(queries, query_key)
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_key).cast(kind).alias("q"), F.col(query_vec).alias("vec"))
    packed = T.StructType([T.StructField("q", T.ArrayType(kind)), T.StructField("qvecs", T.ArrayType(T.DoubleType())), T.StructField("near", T.ArrayType(T.IntegerType()))])
    centres = _centres(index) if probes else None

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, block_queries):
                part = batch.slice(lo, block_queries)
                m = _matrix(part.column(1))
                near = np.zeros(0, np.int32)
                if centres is not None:
                    near = _nearest(m, centres)[:, :probes]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.ravel()]), pa.array([near.ravel()], pa.list_(pa.int32()))], names=packed.names)

    q = asked.mapInArrow(pack, packed).repartition(1)  # read beside the index, which is read once
    fields = [T.StructField(query_key, kind), T.StructField(ids[0], index.schema[ids[0]].dataType.elementType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [T.StructField(c, index.schema[c].dataType.elementType) for c in ids[1:]] + [T.StructField("cell", T.LongType())] * cells)
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in schema]
    width = len(ids)

    def scan(batches):
        held: dict[tuple, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            work = []
            for r in range(batch.num_rows):
                keys = batch.column(4 + width)[r].values
                m = batch.column(5 + width)[r].values.to_numpy().reshape(len(keys), -1)
                angle = np.arccos(np.clip(m @ batch.column(2)[r].values.to_numpy(), -1.0, 1.0))
                work.append((float(angle.min()) - batch.column(1)[r].as_py(), r, keys, m, angle))
            for _, r, keys, m, angle in sorted(work, key=lambda w: w[:2]):  # the nearest blocks first
                block = (len(keys), keys[0].as_py(), keys[-1].as_py())
                if block not in held:
                    held[block] = (values(keys), Best(len(keys), k, width - 1 + cells))
                best = held[block][1]
                bound = np.cos(np.maximum(angle - batch.column(1)[r].as_py(), 0.0)) + _SLACK
                wanted = bound >= best.floor
                if probes:
                    near = batch.column(6 + width)[r].values.to_numpy().reshape(len(keys), -1)
                    wanted &= (near == batch.column(0)[r].as_py()).any(axis=1)
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                columns = [values(batch.column(3 + j)[r].values) for j in range(width)]
                if cells:
                    columns.append(np.full(len(columns[0]), batch.column(0)[r].as_py(), np.int64))
                vectors = batch.column(3 + width)[r].values.to_numpy().reshape(len(columns[0]), -1)
                scores = np.full((len(columns[0]), len(keys)), -np.inf)
                scores[:, at] = np.round(vectors @ m[at].T, DIGITS)
                best.add(columns[0], scores, columns[1:])
        for keys, best in held.values():
            real = np.isfinite(best.s)
            if real.any():
                found = batch_of(keys, best, schema.names).filter(pa.array(real))
                yield pa.RecordBatch.from_arrays([found.column(j).cast(t) for j, t in enumerate(kinds)], names=schema.names)

    best = index.select("cell", "radius", "centroid", *ids, "vecs").crossJoin(q).mapInArrow(scan, schema)
    return top_per(best, [query_key], [F.col("score").desc(), F.col(ids[0])], k, "rank")
