"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.llm.batches import cut, with_columns
from newsiq.llm.graph import components

#: Smallest cosine of a link.
COSINE = 0.98
#: Distinct vectors of a label that a cell is meant for, and cells in all, which bounds the broadcast centroids.
PER_CELL, MAX_CELLS = 4096, 4096
#: Vectors of a label per cell that centroids are fitted on, and rounds of fitting.
SAMPLED, ROUNDS = 16, 8
#: Rows of a cell that one task compares with the whole cell, and columns of one product.
CHUNK, COLUMNS = 2048, 1024

_SLACK = 1e-9


def _units(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Rows of a list column of equal lengths as unit vectors in double precision."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(batch.num_rows, -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(units: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 6) -> np.ndarray:
    """``k`` unit centroids of unit vectors; a cell that runs empty keeps its centroid."""
    centroids = units[np.random.default_rng(seed).choice(len(units), min(k, len(units)), replace=False)].copy()
    for _ in range(rounds):
        cell = (units @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, units)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _fit(reps: DataFrame, seed: int) -> dict:
    """(label, dimension) -> centroids, for those with more than one cell; at most ``MAX_CELLS`` in all."""
    groups = reps.groupBy("label", "dim").count()
    total = groups.agg(F.sum("count")).first()[0] or 0
    per = max(PER_CELL, -(-total // MAX_CELLS) * 2)
    many = cut(groups.where(F.col("count") > per).withColumn("cells", F.ceil(F.col("count") / per)))  # fewer rows than MAX_CELLS
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = reps.join(F.broadcast(many), ["label", "dim"]).where(draw < F.lit(SAMPLED) * F.col("cells") / F.col("count"))
    rows = sample.select("label", "dim", "cells", "embedding").limit(2 * SAMPLED * MAX_CELLS).toArrow()
    out: dict = {}
    keys = list(zip(rows["label"].to_pylist(), rows["dim"].to_pylist(), rows["cells"].to_pylist(), strict=True))
    vectors = rows["embedding"].to_pylist()
    for key in sorted(set(keys), key=str):
        x = np.array([v for v, k in zip(vectors, keys, strict=True) if k == key], np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        out[key[:2]] = k_means(x, int(key[2]), seed=seed)
    return out


def _cells(units: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each vector, and every cell that may be home to a vector within distance ``reach`` of it.

    The home of such a vector is nearer to it than this vector's home is, so
    this vector lies at most ``reach`` on the other side of the plane between
    the two centroids.
    """
    dots = units @ centroids.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    gap = dots[np.arange(len(units)), home][:, None] - dots
    near = gap <= reach * apart[home] + _SLACK
    return home, [np.flatnonzero(row) for row in near]


class _Chunk:
    """Vectors of one task's chunk, compared with their cell as it streams by; the chunk's own come first."""

    def __init__(self, key: dict, cosine: float):
        self.key, self.cosine, self.closed = key, cosine, False
        self.ids, self.units, self.copies = [], [], []

    def add(self, ids: list, units: np.ndarray, copies: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        n = int(own.sum())
        if n:
            self.ids += ids[:n]
            self.units.append(units[:n])
            self.copies.append(copies[:n])
        if n < len(ids):
            self.close()
            for at in range(n, len(ids), COLUMNS):
                yield from self.compare(ids[at : at + COLUMNS], units[at : at + COLUMNS], copies[at : at + COLUMNS])

    def close(self) -> None:
        """Compare the chunk's own vectors with each other, once all are there."""
        if self.closed:
            return
        self.closed, n = True, len(self.ids)
        self.mine = np.vstack(self.units) if n else np.zeros((0, 1))
        copies = np.concatenate(self.copies) if n else np.zeros(0, np.int64)
        self.links, self.root = copies - 1, np.arange(n)
        if not n:
            return
        linked = self.mine @ self.mine.T >= self.cosine
        np.fill_diagonal(linked, False)
        self.links = self.links + linked @ copies
        i, j = np.nonzero(linked)
        while True:
            low = self.root.copy()
            np.minimum.at(low, i, self.root[j])
            if (low == self.root).all():
                return
            self.root = low

    def compare(self, ids: list, units: np.ndarray, copies: np.ndarray) -> Iterator[tuple]:
        """Count links to other vectors of the cell; (other, a vector of the chunk linked to it)."""
        if not self.ids:
            return
        linked = self.mine @ units.T >= self.cosine
        self.links = self.links + linked @ copies
        i, j = np.nonzero(linked)
        if not len(i):
            return
        other = np.full(len(ids), len(self.ids))
        while True:
            before = self.root.copy()
            np.minimum.at(other, j, self.root[i])
            low = self.root.copy()
            np.minimum.at(low, i, other[j])
            self.root = low[low]
            if (self.root == before).all():
                break
        for k in np.unique(j).tolist():
            yield ids[k], 0, self.ids[other[k]]

    def finish(self) -> Iterator[tuple]:
        self.close()
        yield from zip(self.ids, self.links.tolist(), (self.ids[r] for r in self.root.tolist()), strict=True)


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, seed: int = 6
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``df``.

    Vectors with equal, non-null labels and a cosine of at least ``cosine`` in
    double precision are linked.  ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest id reachable by links, ``kept``
    says that it is the row's own.

    Vectors that are null, zero, or hold null or non-finite components, and
    those with a null label or id, link with nothing; only vectors of one
    length are compared.  Equal vectors of a label are one class, counted with
    their number, so a group of copies is one vector in all that follows.
    Repeated rows are copies of each other.  An empty table gives no rows;
    other columns are ignored.

    Every class goes to its nearest centroid's cell and, as a visitor, to each
    cell whose own vectors can reach the cosine with it, so cells lose no link.
    A cell is compared in chunks of ``CHUNK`` of its own vectors, against the
    whole cell streaming by; a task sends on counts and, per chunk, a tree of
    links, never pairs.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    classes = valid.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = cut(classes.select(F.col("rep").alias("id"), "label", "embedding", "copies", F.size("embedding").alias("dim")))
    shared = df.sparkSession.sparkContext.broadcast(_fit(reps, seed))
    reach = float(np.sqrt(2 - 2 * cosine))

    def assign(batch: pa.RecordBatch) -> list:
        homes, cells = np.zeros(batch.num_rows, np.int64), [np.zeros(1, np.int64)] * batch.num_rows
        keys = list(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))
        for key in {k for k in keys if k in shared.value}:
            at = np.array([i for i, k in enumerate(keys) if k == key])
            home, near = _cells(_units(batch.take(pa.array(at)), 2), shared.value[key], reach)
            homes[at] = home
            for i, n in zip(at, near, strict=True):
                cells[i] = n
        return [pa.array(homes, pa.int32()), pa.array(cells, pa.list_(pa.int32()))]

    placed = with_columns(reps, "home int, cells array<int>", assign)
    sizes = placed.groupBy("label", "dim", "home").count()
    sizes = cut(sizes.select("label", "dim", F.col("home").alias("cell"), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    visits = placed.withColumn("cell", F.explode("cells")).join(sizes, ["label", "dim", "cell"])
    own = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("chunks")).cast("int")
    visits = visits.select(
        "id", "embedding", "copies", "label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        ((F.col("home") == F.col("cell")) & (F.col("chunk") == own)).alias("own"),
    )
    key = ["label", "dim", "cell", "chunk"]
    dealt = visits.repartition(*key).sortWithinPartitions(*key, F.col("own").desc())
    dealt = dealt.select("id", "embedding", "copies", "own", F.struct(*key).alias("key"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("other", kind)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, id_type = None, None

        def made(found: list) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), id_type)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=schema.names)

        for batch in batches:
            id_type, keys, found = batch.column(0).type, batch.column(4).to_pylist(), []
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if chunk is not None and chunk.key != keys[a]:
                    found += chunk.finish()
                    chunk = None
                chunk = chunk or _Chunk(keys[a], cosine)
                part = batch.slice(a, b - a)
                found += chunk.add(part.column(0).to_pylist(), _units(part, 1), part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False))
            yield made(found)
        if chunk is not None:
            yield made(list(chunk.finish()))

    links = cut(dealt.mapInArrow(compare, schema))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(links.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_class = reps.select("id", "label", "embedding").join(counts, "id").join(found, "id", "left")
    per_class = per_class.select("label", "embedding", "n", F.coalesce("component", "id").alias("component"))
    mine = valid.join(cut(per_class), ["label", "embedding"]).select("id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = mine.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
