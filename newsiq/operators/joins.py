"""Join helpers.

Which physical join runs is left to Catalyst and AQE; nothing is hinted as
broadcast and no plan depends on a row count taken while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, other: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Rows without a match (``NOT EXISTS``)."""
    return df.join(other, on, "left_anti")


def only_in(df: DataFrame, other: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Rows with a match (``EXISTS`` / ``IN``)."""
    return df.join(other, on, "left_semi")


def known_urls(batch: DataFrame, *tables: DataFrame, url: str = "url") -> DataFrame:
    """``batch`` plus ``is_known``: its url is in one of ``tables``.

    The tables are reduced to distinct urls first, so a url repeated by a
    large share of a table is one row by the time of the join.
    """
    known = tables[0].select(url)
    for table in tables[1:]:
        known = known.unionByName(table.select(url))
    known = known.where(F.col(url).isNotNull()).distinct().withColumn("is_known", F.lit(True))
    return batch.join(known, url, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def explode_left(df: DataFrame, array: str | Column, name: str) -> DataFrame:
    """One row per element, keeping rows whose array is empty or NULL."""
    return df.select("*", F.explode_outer(array).alias(name))


def left_counts(df: DataFrame, other: DataFrame, on: str | list[str], **aggs: Column) -> DataFrame:
    """Left join with per-key aggregates of ``other``, computed before the join.

    Joining first would multiply rows when several children are attached.
    """
    keys = [on] if isinstance(on, str) else on
    return df.join(other.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys, "left")


SALTS = 8


def skew_join(big: DataFrame, small: DataFrame, on: str, salts: int = SALTS) -> DataFrame:
    """Inner join on a key that may hold a large share of ``big``; ``small`` has one row per key.

    A key's rows of ``big`` are dealt to ``salts`` parts by a hash of the whole
    row, and ``small`` is repeated for each part.  So no task has to take a hot
    key as a whole, whatever the size of the tables, and AQE can split a part
    further.
    """
    key = "_salt"
    dealt = big.withColumn(key, F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    repeated = small.withColumn(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(repeated, [on, key]).drop(key)


def or_of_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join on "equal ``keys`` or a listed pair" as classes instead of pairs.

    Gives (links, outside): ``links`` has a row per row of ``left`` with its
    class, the values of ``keys``, and the number of ``right`` rows in it,
    which are the rows of ``right`` with these values; ``outside`` has the
    (left, right) pairs of ``listed`` that lie in other classes.  Together they
    are every pair of the join once, in as many rows as the tables have.  Null
    keys are equal to nothing.
    """
    sizes = right.groupBy(*keys).agg(F.count("*").alias("members"))
    links = left.select(left_id, *keys).join(sizes, keys, "left").withColumn("members", F.coalesce("members", F.lit(0)))
    mine = left.select(left_id, *[F.col(k).alias(f"_{k}") for k in keys])
    pairs = listed.select(left_id, right_id).distinct().join(mine, left_id).join(right.select(right_id, *keys), right_id)
    same = [F.coalesce(F.col(k) == F.col(f"_{k}"), F.lit(False)) for k in keys]
    outside = pairs.where(~F.greatest(F.lit(False), F.least(F.lit(True), *same))).select(left_id, right_id)
    return links.select(left_id, *keys, "members"), outside
