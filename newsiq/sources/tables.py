"""Table scans and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source types read by the feed reader.
FEED_TYPES = ("rss", "wechat", "official_rss", "reddit", "youtube")


def read_table(spark: SparkSession, directory: str, name: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan of one stored table; the column list prunes the scan itself."""
    path = f"{directory.rstrip('/')}/{name}"
    df = spark.read.format(fmt).load(f"{path}.{fmt}" if fmt == "parquet" else path)
    return df.select(*columns) if columns else df


def active_sources(sources: DataFrame, types: tuple[str, ...] = FEED_TYPES) -> DataFrame:
    return sources.where(F.col("is_active") & F.col("source_type").isin(*types))


def since_cursor(raw: DataFrame, sources: DataFrame, as_of: str, hours: int = 25) -> DataFrame:
    """(source_id, since): newest published item of each source, else ``as_of`` minus some hours.

    Undated rows do not move the mark.
    """
    newest = raw.groupBy("source_id").agg(F.max("published_at").alias("newest"))
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return sources.select("source_id").join(newest, "source_id", "left").select(
        "source_id", F.coalesce("newest", start).alias("since")
    )


def newer_than_cursor(items: DataFrame, cursor: DataFrame) -> DataFrame:
    """Items published at or after their source's mark."""
    return items.join(cursor, "source_id").where(F.col("published_at") >= F.col("since")).drop("since")


def recent(df: DataFrame, as_of: str, days: int = 30, published: str = "published_at") -> DataFrame:
    """Drop items published before UTC midnight of ``as_of`` minus ``days - 1`` days.

    Undated items stay; text dates that do not parse stay too.
    """
    cutoff = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")) - F.expr(f"INTERVAL {int(days) - 1} DAYS")
    when = F.col(published)
    if dict(df.dtypes)[published] == "string":
        from newsiq.functions.dates import parse_date

        when = parse_date(published)
    return df.where(when.isNull() | (when >= cutoff.cast("timestamp_ntz")))
