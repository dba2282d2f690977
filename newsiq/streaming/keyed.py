"""A keyed table for streaming sinks: hash buckets of Parquet files under a manifest.

A row's bucket follows from its key.  A batch writes the buckets that it
touches as a new version, and then a manifest that names, for every bucket,
the versions that hold its rows; a reader sees the newest manifest, so a batch
that fails half way is not seen, and one that runs again replaces itself.
Buckets that a batch does not touch are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, bucket int"


class KeyedTable:
    """Rows of ``schema`` under ``path``, dealt to ``buckets`` by ``keys``; the number of buckets must not change."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        """Names in a folder of the table, in whatever store it is."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []

    def _delete(self, folder: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        done = [n for n in self._names("manifest") if n.startswith("v=") and "_SUCCESS" in self._names(f"manifest/{n}")]
        return sorted(int(n[2:]) for n in done)

    def _parts(self, version: int) -> list[tuple[int, int]]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()  # at most a row per bucket and kept version
        return sorted((r.version, r.bucket) for r in rows)

    def parts(self, before: int | None = None) -> list[tuple[int, int]]:
        """(version, bucket) of the folders that hold the table, or held it before a version."""
        old = [v for v in self.versions() if before is None or v < before]
        return self._parts(old[-1]) if old else []

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or its ``buckets`` alone, now or as it was before a version."""
        wanted = [f"{self.path}/data/v={v}/_bucket={b}" for v, b in self.parts(before) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a batch's keys."""
        return sorted(r.b for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def commit(self, rows: DataFrame, version: int, buckets: list[int], replace: bool) -> None:
        """Write ``rows`` of ``buckets`` as ``version``, instead of what these buckets held or, without ``replace``, beside it."""
        kept = [(v, b) for v, b in self.parts(version) if not (replace and b in buckets)]
        rows.select(*self.schema.names).withColumn("_bucket", self.bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v={version}")
        new = [(version, int(n[8:])) for n in self._names(f"data/v={version}") if n.startswith("_bucket=")]
        self.spark.createDataFrame(kept + new, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self._clean(version)

    def _clean(self, version: int) -> None:
        """Remove what neither this version nor the one before it, from which this one would be made again, needs."""
        done = [v for v in self.versions() if v <= version]
        used = {p for v in done[-2:] for p in self._parts(v)}
        for v in sorted({int(n[2:]) for n in self._names("data") if n.startswith("v=")}):
            if v > version:
                continue
            here = [int(n[8:]) for n in self._names(f"data/v={v}") if n.startswith("_bucket=")]
            for b in here:
                if (v, b) not in used:
                    self._delete(f"data/v={v}/_bucket={b}")
            if v < version and not any((v, b) in used for b in here):
                self._delete(f"data/v={v}")
        for v in done[:-2]:
            self._delete(f"manifest/v={v}")
