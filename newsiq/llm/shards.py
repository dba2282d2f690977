"""Sharding by proportional stratified interleaving (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the shuffle hash, and slots of the unit interval, that a ranking is split by.
DIGITS, PARTS = 3, 4096


def _ranked(df: DataFrame, keys: list[str], part: str, order: list[Column], rank: str) -> DataFrame:
    """``df`` with the 0-based rank of each row among its ``keys``, ordered by ``part`` and then ``order``.

    Rows are numbered inside (keys, part); a part's offset is the sum of the
    counts of the parts before it.  ``part`` is spread evenly by construction,
    so no task holds a whole key, and the table of counts has at most
    ``PARTS`` rows a key.
    """
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    counts = df.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = df.withColumn("_in", F.row_number().over(inner))
    joined = numbered.join(offsets, [*keys, part])
    return joined.withColumn(rank, F.col("_before") + F.col("_in") - 1).drop("_before", "_in")


def interleave(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source",
    seed: int = 8, keep: list[str] | None = None,
) -> DataFrame:
    """(id, [keep...], size, text_crc32, shard, slot): every row in one of ``shards`` shards.

    Rows are shuffled inside their stratum by an md5 of seed and id, ranked,
    and sorted by fractional rank (rank + 1/2) / stratum size.  Cutting that
    order into ``shards`` runs whose lengths differ by at most one gives every
    shard the mixture of the whole, up to the strata's rounding at the cuts; ``slot`` is the place in the shard, gapless
    from 0.  ``size`` is the UTF-8 length plus 1, ``text_crc32`` its checksum.

    A null stratum is a stratum of its own; a null text counts as empty; a null
    id is an id.  Ties, such as repeated rows, are ordered by id and checksum;
    rows alike in both are interchangeable.  An empty table gives no rows.
    Columns not in ``keep`` are dropped, so names in ``df`` cannot clash.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    word = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.struct(*[F.col(c) for c in keep or []]).alias("_keep") if keep else F.lit(0).alias("_keep"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(word).alias("_hash"),
    )
    rows = rows.withColumn("_part", F.substring("_hash", 1, DIGITS))
    tie = [F.col("_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    rows = _ranked(rows, ["_stratum"], "_part", [F.col("_hash"), *tie], "_rank")
    sizes = rows.groupBy("_stratum").agg(F.count("*").alias("_of"))
    rows = rows.join(sizes, "_stratum").withColumn("_at", (F.col("_rank") + 0.5) / F.col("_of"))
    rows = rows.withColumn("_slice", F.floor(F.col("_at") * PARTS).cast("int")).withColumn("_all", F.lit(0))
    rows = _ranked(rows, ["_all"], "_slice", [F.col("_at"), F.col("_stratum"), F.col("_hash"), *tie], "_place")
    total = rows.groupBy("_all").agg(F.count("*").alias("_total"))
    rows = rows.join(F.broadcast(total), "_all")  # one row
    rows = rows.withColumn("shard", F.expr(f"cast(_place * {int(shards)} div _total as int)"))
    first = F.expr(f"(cast(shard as bigint) * _total + {int(shards)} - 1) div {int(shards)}")
    rows = rows.withColumn("slot", F.col("_place") - first)
    return rows.select(
        F.col("_id").alias(id_col), *[F.col(f"_keep.{c}").alias(c) for c in keep or []],
        "size", "text_crc32", "shard", "slot",
    )


def write(df: DataFrame, path: str, shards: int = 16, **options) -> None:
    """The shards as Parquet folders ``shard=n``; a shard's files follow each other in slot order.

    Columns of ``df`` named size, text_crc32, shard or slot are replaced.
    """
    made = ("size", "text_crc32", "shard", "slot", options.get("id_col", "doc_id"))
    out = interleave(df, shards, keep=[c for c in df.columns if c.lower() not in made], **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
