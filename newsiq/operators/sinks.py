"""Write rules of keyed tables on plain parquet.

Each function returns the new content of the target (or of the batch part to
append) as a lazy DataFrame; :func:`write_version` stores it.  Keys need not be
unique in the batch: the winner per key is taken before any join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.operators.windows import latest_per


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def new_rows(target: DataFrame, batch: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Rows of ``batch`` an insert-ignore would add: first per key, key not in ``target``."""
    keys = _keys(key)
    return latest_per(batch, keys, order).join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """``target`` plus the new rows of ``batch``; existing rows are untouched."""
    return target.unionByName(new_rows(target, batch, key, order), allowMissingColumns=True)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str | list[str],
    order: list[Column],
    update_cols: Iterable[str] | None = None,
) -> DataFrame:
    """Insert new keys; for existing keys the batch value wins.

    With ``update_cols`` only those columns are refreshed, and only by non-null
    batch values.  One full outer join on the key; no row of either side is
    copied twice.
    """
    keys = _keys(key)
    fresh = latest_per(batch, keys, order)
    cols = [c for c in target.columns if c not in keys]
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols if c in fresh.columns], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(renamed, keys, "full_outer")
    out = []
    for c in cols:
        if c not in fresh.columns:
            out.append(F.col(c))
        elif update_cols is None:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c in set(update_cols):
            out.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return both.select(*keys, *out).select(*target.columns)


def upsert_merge_map(target: DataFrame, batch: DataFrame, key: str, map_col: str) -> DataFrame:
    """Upsert that merges ``map_col``: batch entries override, other old entries stay."""
    cols = [c for c in target.columns if c not in (key, map_col)]
    new = batch.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.col(map_col).alias("_n_map"), F.lit(True).alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce(F.col(map_col), empty), F.coalesce(F.col("_n_map"), empty))
    both = target.join(new, key, "full_outer")
    return both.select(
        key,
        *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(F.col("_new"), merged).otherwise(F.col(map_col)).alias(map_col),
    ).select(*target.columns)


def patch_if_null(target: DataFrame, patch: DataFrame, key: str, col: str) -> DataFrame:
    """Set ``col`` from ``patch`` only where it is still NULL; the earliest patch per key wins."""
    first = patch.groupBy(key).agg(F.min(col).alias("_patch"))
    out = target.join(first, key, "left")
    return out.withColumn(col, F.coalesce(col, "_patch")).select(*target.columns)


def update_from(target: DataFrame, source: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Copy ``cols`` from ``source`` where they differ; NULL source values never overwrite.

    ``changed`` marks rows that took a new value.
    """
    src = source.select(on, *[F.col(c).alias(f"_s_{c}") for c in cols])
    out = target.join(src, on, "left")
    differs = F.lit(False)
    for c in cols:
        differs = differs | (F.col(f"_s_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_s_{c}")))
    return out.withColumn("changed", differs).select(
        *[F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns],
        "changed",
    )


def write_version(df: DataFrame, base: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table next to the old ones and return its path.

    A table that is read and rewritten in one job must not overwrite itself;
    readers switch to the returned path once the write has succeeded.
    """
    path = f"{base.rstrip('/')}/v={version}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
