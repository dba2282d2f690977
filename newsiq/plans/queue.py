"""Work queue of raw items: claiming, failing, requeueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3


def claim_tier(published: Column, fetched: Column, as_of: Column, tz: str = "America/New_York") -> Column:
    """0 published today, 1 undated and fetched today, 2 the rest; days are local to ``tz``.

    Times without a zone are UTC.
    """
    day = lambda t: F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), t))
    today = day(as_of)
    return (
        F.when(published.isNotNull() & (day(published) == today), 0)
        .when(published.isNull() & (day(fetched) == today), 1)
        .otherwise(2)
    )


def next_batch(raw: DataFrame, as_of: str, n: int, tz: str = "America/New_York") -> DataFrame:
    """The ``n`` pending rows to work on next, by tier and then oldest fetch; ``n`` is the batch size."""
    now = F.lit(as_of).cast("timestamp_ntz")
    tier = claim_tier(F.col("published_at"), F.col("fetched_at"), now, tz)
    pending = raw.where(F.col("status") == "pending").withColumn("tier", tier.cast("long"))
    return pending.orderBy("tier", "fetched_at", "id").limit(n)


def after_failure(df: DataFrame, error: Column | str) -> DataFrame:
    """Rows after one more failure: back to pending, or error at the third."""
    count = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
    return (
        df.withColumn("last_error", F.lit(error) if isinstance(error, str) else error)
        .withColumn("status", F.when(count >= MAX_RETRIES, "error").otherwise("pending"))
        .withColumn("retry_count", count)
    )


def requeue(
    raw: DataFrame, sources: DataFrame, news: DataFrame, source_type: str, reason: str, days: int, as_of: str, limit: int | None = None
) -> DataFrame:
    """Rejected rows of one source type to try again, unless they became an article.

    ``limit`` gives the batched form, newest first.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    wanted = sources.where(F.col("source_type") == source_type).select("source_id")
    rows = raw.where((F.col("status") == "error") & (F.col("last_error") == reason))
    if limit is None:
        rows = rows.where(F.col("fetched_at") > since)
    rows = rows.join(wanted, "source_id", "left_semi")
    rows = rows.join(news.select(F.col("raw_ingestion_id").alias("id")), "id", "left_anti")
    if limit is not None:
        rows = rows.orderBy(F.col("fetched_at").desc(), "id").limit(limit)
    return (
        rows.withColumn("status", F.lit("pending"))
        .withColumn("last_error", F.lit(None).cast("string"))
        .withColumn("retry_count", F.lit(0).cast("long"))
    )
