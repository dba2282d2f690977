"""Aggregate expressions: ordered lists, rates, object maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsiq.functions.text import _c


def rate(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; NULL counts as not holding."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def rate_of(cond: Column, among: Column) -> Column:
    """Share within the rows where ``among`` holds; NULL when there is none."""
    return F.avg(F.when(among, F.when(cond, 1.0).otherwise(0.0)))


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ordered_list(value: Column | str, *order: Column | str, where: Column | None = None) -> Column:
    """Array of ``value`` in the order of ``order``; use for lists known to be short."""
    keys = [_c(o).alias(f"k{i}") for i, o in enumerate(order)]
    item = F.struct(*keys, _c(value).alias("v"))
    if where is not None:
        item = F.when(where, item)
    return F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"])


def ordered_structs(fields: list[Column], *order: Column | str, where: Column | None = None) -> Column:
    """Array of structs in the order of ``order``."""
    return ordered_list(F.struct(*fields), *order, where=where)


def object_map(key: Column | str, value: Column | str) -> Column:
    """Map built from one (key, value) pair per row."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(_c(key).alias("k"), _c(value).alias("v")))))


def distinct_join(value: Column | str, width: int = 180, sep: str = " | ", where: Column | None = None) -> Column:
    """Distinct values cut to ``width`` characters, sorted and joined; NULL when none."""
    cut = F.substring(_c(value), 1, width)
    if where is not None:
        cut = F.when(where, cut)
    return F.nullif(F.array_join(F.array_sort(F.collect_set(cut)), sep), F.lit(""))
