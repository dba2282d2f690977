"""Arrow batches of Spark partitions: appending columns, slicing by bytes, stored intermediates."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes handled at once inside a task; a longer row is handled alone.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, else one inside the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        if not spark.sparkContext.master.startswith("local") and folder.split(":")[0] in ("file", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


def cut(df: DataFrame, at_once: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder; later steps read the copy, also after executors were lost.

    A writer holds a row group, and a reader up to 4096 rows of one; with rows
    of megabytes ``at_once`` says how many rows that may be.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.row.count.limit", at_once) if at_once else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Give memory that is free back to the machine: a worker lives on between tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def freeing(run: Callable) -> Callable:
    """``run`` over the batches of a task, with :func:`trim` at its end."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return over


def with_columns(
    df: DataFrame, added: str, fn: Callable[[pa.RecordBatch], list], keep: list[str] | None = None, by: str | None = None
) -> DataFrame:
    """``df`` with the columns of DDL ``added`` that ``fn`` computes per Arrow batch.

    With a text column ``by`` it computes them, and hands them on, for about
    ``SLICE_BYTES`` of that text at a time.

    ``fn`` sees all columns; only ``keep`` (default: all) are returned beside
    the new ones.  A column of ``df`` with a new column's name is replaced.
    """
    new = T.StructType.fromDDL(added)
    taken = {n.lower() for n in new.names}
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([df.schema[c] for c in stay] + list(new.fields))
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(buffers(strings(whole, by))[1]) if by else [(0, whole.num_rows)] * bool(whole.num_rows):
                batch = whole.slice(lo, hi - lo)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in stay]
                yield pa.RecordBatch.from_arrays(arrays + list(fn(batch)), names=names)
        trim()

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch with null as the empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of the texts in them) of an Arrow string array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    ends = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


_HELD: dict[str, tuple] = {}


def held(owner: str, key, build: Callable):
    """What ``build`` makes for ``key``, kept in the Python worker until it works for another operator or key."""
    if owner not in _HELD or _HELD[owner][0] != key:
        _HELD.clear()
        _HELD[owner] = key, build()
    return _HELD[owner][1]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of ``names`` under free names, and what each of them is called now."""
    own = {c: free_name(df, f"_own_{c}") for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(own), own


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; every row is in exactly one."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi
