"""Exact quantiles of groups of any size, by counting positions in a distributed sort.

The values of a group are reduced to one row per distinct value with its
count, before and after the shuffle; these rows are ranged by group and value,
so a group and a range of it may lie in many partitions.  The rows before a
value are those of the group's earlier partitions, of which there is one sum
each, and the earlier values of its own partition.  Nothing holds the values
of a group together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsiq.operators.lineage import cut


def _positions(values: DataFrame, parts: int) -> DataFrame:
    """(g, v, before, upto): how many values of the group lie before each distinct one, and up to it."""
    counted = values.groupBy("g", "v").agg(F.count("*").alias("n"))
    # written, as the ranges of a second run need not be the same
    ranged = cut(counted.repartitionByRange(parts, "g", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("g", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.withColumn("upto", upto).join(offsets, ["g", "part"])
    return rows.select("g", "v", (F.col("offset") + F.col("upto") - F.col("n")).alias("before"), (F.col("offset") + F.col("upto")).alias("upto"))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str | Column, float, str]], parts: int | None = None) -> DataFrame:
    """One row per group of ``df`` with a column per entry of ``wanted``: name -> (values, p, kind).

    ``kind`` ``cont`` interpolates between the two nearest values, as double;
    ``disc`` takes the ``ceil(p * n)``-th smallest value, as double.
    Nulls are no values; a group without any has null.  Null keys are a group.
    Without ``by`` there is one row, also for an empty table.  ``parts`` are the
    ranges of the sort, by default the session's number of shuffle partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    groups = df.select(key.alias("g")).distinct() if by else df.sparkSession.range(1).select(key.alias("g"))
    out = groups
    sources = list(dict.fromkeys((str(x), kind) for x, _, kind in wanted.values()))
    for source, kind in sources:
        specs = {name: p for name, (x, p, k) in wanted.items() if (str(x), k) == (source, kind)}
        value = next(x for x, _, k in wanted.values() if (str(x), k) == (source, kind))
        value = F.col(value) if isinstance(value, str) else value
        rows = df.select(key.alias("g"), (value.cast("double") if kind == "cont" else value).alias("v")).where("v IS NOT NULL")
        placed = _positions(rows, parts)
        total = rows.groupBy("g").agg(F.count("*").alias("total"))
        ranks = [F.struct(F.lit(name).alias("name"), *_ranks(p, kind)) for name, p in specs.items()]
        targets = total.select("g", F.inline(F.array(*ranks)))
        targets = targets.select("g", "name", "share", F.posexplode(F.array("low", "high")).alias("side", "place"))
        hits = placed.join(targets, "g").where((F.col("before") < F.col("place")) & (F.col("place") <= F.col("upto")))
        ends = hits.groupBy("g", "name").agg(F.max("share").alias("share"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"))
        found = F.when((F.col("share") == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise((1 - F.col("share")) * F.col("low") + F.col("share") * F.col("high")) if kind == "cont" else F.col("low").cast("double")
        one = ends.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, found)).alias(name) for name in specs])
        out = out.join(one, "g", "left")
    return out.select(*[F.col("g")[c].alias(c) for c in by], *wanted)


def _ranks(p: float, kind: str) -> list[Column]:
    """(low, high, share): the places, from 1, between which the quantile lies, and how far."""
    if kind == "cont":
        at = F.lit(float(p)) * (F.col("total") - 1)
        return [(F.floor(at) + 1).alias("low"), (F.ceil(at) + 1).alias("high"), (at - F.floor(at)).alias("share")]
    place = F.greatest(F.ceil(F.lit(float(p)) * F.col("total")), F.lit(1))
    return [place.alias("low"), place.alias("high"), F.lit(0.0).alias("share")]
