"""Grouped feed: pages, access, threads, new-item counts, window menu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import social as so
from newsiq.functions import text as tx
from newsiq.functions.stats import ordered_list
from newsiq.operators.windows import first_rows
from newsiq.plans.enrich import bilingual

# Source types shown as author threads.
THREAD_TYPES = ("x_api", "apify_tweet")


def _ts(x: str | Column) -> Column:
    return F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x


def page(df: DataFrame, limit: int, cursor: int | None = None, strict: bool = True, table: DataFrame | None = None) -> DataFrame:
    """One keyset page, newest first, with ``next_cursor`` (the oldest id) on every row.

    The cursor is an id of ``table`` (default ``df``).  ``strict`` compares
    creation times only, so rows created at the cursor's very time are skipped;
    ``strict=False`` breaks ties by id and skips nothing.
    """
    rows = df
    if cursor is not None:
        at = (table if table is not None else df).where(F.col("id") == cursor).select("created_at").scalar()
        older = F.col("created_at") < at
        if not strict:
            older = older | ((F.col("created_at") == at) & (F.col("id") < cursor))
        rows = rows.where(older)
    top = first_rows(rows, [F.col("created_at").desc(), F.col("id").desc()], limit)
    # the smallest (created_at, id) of the page, looked up in its few rows
    last = top.select(F.min(F.struct("created_at", "id"))["id"]).scalar()
    return top.withColumn("next_cursor", last)


def apply_access(df: DataFrame, can_view: bool, overrides: DataFrame, premium: list[str], key: str = "id") -> DataFrame:
    """Mask premium columns and resolve questions: the user's own rows override the defaults.

    ``overrides`` are the caller's rows (article_id, questions).
    """
    hide = lambda c: (F.col(c) if can_view else F.lit(None).cast(dict(df.dtypes)[c])).alias(c)
    own = overrides.select(F.col("article_id").alias(key), F.col("questions").alias("_own"), F.lit(True).alias("_has"))
    out = df.join(own, key, "left") if can_view else df.withColumn("_own", F.lit(None).cast("string")).withColumn("_has", F.lit(None).cast("boolean"))
    questions = F.coalesce("_own", "questions") if can_view else F.lit(None).cast("string")
    source = F.when(F.col("_has"), "user_override").when(F.col("questions").isNotNull(), "auto_default") if can_view else F.lit(None).cast("string")
    keep = [c for c in df.columns if c not in ("questions", *premium)]
    return out.select(*keep, questions.alias("questions"), source.alias("questions_source"), *[hide(c) for c in premium])


def grouped(
    news: DataFrame,
    sources: DataFrame,
    start: str,
    end: str,
    category: str | None = None,
    limit: int = 10,
    cursor: int | None = None,
    can_view: bool = False,
    overrides: DataFrame | None = None,
    analysis: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """The public feed page of a date window, with thread and analysis columns.

    The page is cut before the joins that only add columns.
    """
    rows = news.where(tx.in_window("published_at", "created_at", _ts(start), _ts(end)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    rows = rows.join(sources.select("source_id"), "source_id", "left_semi")
    rows = page(rows, limit, cursor, strict, news)
    thread = F.col("source_type").isin(*THREAD_TYPES)
    src = sources.select(
        "source_id", "source_type", F.col("name").alias("source_name"), F.col("category").alias("source_category"),
        F.when(thread, F.col("handle")).alias("thread_group"), F.when(thread, F.col("bio")).alias("thread_bio"),
    )
    rows = bilingual(rows).join(src, "source_id")
    premium: list[str] = []
    if analysis is not None:
        counts = [c for c in ("up_count", "down_count") if c in analysis.columns]
        ada = analysis.select(
            F.col("article_id").alias("id"), F.col("analysis_id").alias("deep_analysis_id"), F.col("status").alias("deep_analysis_status"), *counts
        )
        rows = rows.join(ada, "id", "left")
        premium = ["deep_analysis_id", "deep_analysis_status", *counts]
    if overrides is not None or not can_view:
        empty = overrides if overrides is not None else news.select(F.col("id").alias("article_id"), "questions").limit(0)
        rows = apply_access(rows, can_view, empty, premium)
    return rows


def threads(page_rows: DataFrame, page_keys: list[str] | None = None) -> DataFrame:
    """Cards of feed pages: posts of one author on a page form one card at the place of the first.

    ``page_rows`` has pos, id, url, thread_group and likes, and ``page_keys``
    when it holds many pages.  A card lists its post ids by likes, most first;
    it never holds more than a page.
    """
    keys = page_keys or []
    handle = F.coalesce("thread_group", so.thread_handle("url"))
    rows = page_rows.withColumn("handle", handle)
    card = F.coalesce(F.concat(F.lit("h:"), F.col("handle")), F.concat(F.lit("i:"), F.col("id").cast("string")))
    out = rows.withColumn("card", card).groupBy(*keys, "card").agg(
        F.min("pos").cast("long").alias("position"),
        F.max("handle").alias("handle"),
        F.count("*").alias("posts"),
        F.sum(F.coalesce("likes", F.lit(0))).cast("long").alias("total_likes"),
        F.array_join(ordered_list(F.col("id").cast("string"), -F.coalesce("likes", F.lit(0)), "pos"), ",").alias("ids"),
    )
    return out.drop("card")


def new_since(news: DataFrame, baseline: str, category: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Number of items created after the baseline, under the feed's filters."""
    rows = news.where(F.col("created_at") > _ts(baseline))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if start is not None:
        rows = rows.where(tx.in_window("published_at", "created_at", _ts(start), _ts(end)))
    return rows.agg(F.count("*").alias("new_items"))


def window_of(published: Column | str, created: Column | str, today: Column, step: int) -> Column:
    """Index of the menu window an item falls into; 0 ends today.

    The windows of one cadence tile the calendar, so this replaces a range join.
    """
    day = F.to_date(F.coalesce(published, created))
    return F.floor(F.datediff(today, day) / step).cast("long")


def windows(news: DataFrame, as_of: str, step: int, limit_date: str, max_windows: int | None = None) -> DataFrame:
    """Every window of the menu with its bounds and article count, empty ones included; ``max_windows`` cuts a menu."""
    today, last = F.lit(as_of).cast("date"), F.lit(limit_date).cast("date")
    spark = news.sparkSession
    count = F.ceil(F.datediff(today, last) / step).cast("long")
    count = F.least(count, F.lit(max_windows).cast("long")) if max_windows is not None else count
    menu = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(0)))).alias("idx"))
    menu = menu.withColumn("anchor", F.date_sub(today, (F.col("idx") * step).cast("int")))
    menu = menu.select("idx", "anchor", F.date_sub("anchor", step - 1).alias("start"), F.date_add("anchor", 1).alias("end"))
    counted = news.groupBy(window_of("published_at", "created_at", today, step).alias("idx")).agg(F.count("*").alias("articles"))
    return menu.join(counted, "idx", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
