"""Ranking within groups and global top-k.

``row_number() <= k`` filters are planned with a group limit below the
exchange: a task ships at most ``k`` rows per key, so one key that holds a
large share of the table does not reach one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the position of each row within its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows of each group; keeps the position as ``name`` when given."""
    out = ranked(df, keys, order, name or "_rn")
    out = out.where(F.col(name or "_rn") <= n)
    return out if name else out.drop("_rn")


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group under ``order`` (``DISTINCT ON``)."""
    return top_per(df, keys, order, 1)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top-n, planned as a per-task top-n and one merge."""
    return df.orderBy(*order).limit(n)
