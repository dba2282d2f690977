"""Enrichment of claimed items: engagement, metadata, category, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx

# Article categories.
CATEGORIES = ("industry", "technical_frontier", "career_community")
# Source types whose metadata passes through.
METADATA_TYPES = ("aihot", "official_rss", "official_html_index")
# Engagement keys a score is taken from, in order.
SCORE_KEYS = ("likes", "votes", "score")


def engagement(url: Column | str, source_type: Column | str, metadata: Column | str) -> Column:
    """Engagement map by kind of source, from a string map; NULL when there is none."""
    url, kind, m = tx._c(url), tx._c(source_type), tx._c(metadata)
    at = lambda k: F.element_at(m, k)
    or_zero = lambda k: F.coalesce(at(k), F.lit("0"))
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    has = m.isNotNull()
    return (
        F.when(url.contains("x.com") & url.contains("/status/") & has, pair("likes", or_zero("likes"), "retweets", or_zero("retweets")))
        .when(url.startswith("https://github.com/") & at("stars").isNotNull(), pair("stars", at("stars")))
        .when(url.contains("reddit.com") & at("score").isNotNull(), pair("score", at("score"), "num_comments", or_zero("num_comments")))
        .when((kind == "youtube") & has, pair("likes", or_zero("likes"), "show_name", F.coalesce(at("show_name"), F.lit(""))))
        .when(F.coalesce(at("show_name"), F.lit("")) != "", pair("show_name", at("show_name")))
    )


def engagement_score(*values: Column | str) -> Column:
    """First present of likes, votes and score, else 0; a present 0 stops the search."""
    return F.coalesce(*[tx._c(v) for v in values], F.lit(0))


def metadata(source_type: Column | str, meta: Column | str) -> Column:
    """Source metadata for the kinds that pass it on, else NULL."""
    return F.when(tx._c(source_type).isin(*METADATA_TYPES), tx._c(meta))


def category(df: DataFrame, sources: DataFrame, label: str = "llm_category") -> tuple[DataFrame, DataFrame]:
    """(rows with a final category, mismatch rows): invalid labels fall back to the source's."""
    src = sources.select("source_id", F.col("category").alias("_source_category"))
    out = df.join(src, "source_id", "left")
    valid = F.coalesce(F.col(label).isin(*CATEGORIES), F.lit(False))
    rows = out.withColumn("category", F.when(valid, F.col(label)).otherwise(F.col("_source_category")))
    note = F.concat(
        F.lit("llm_output="), F.coalesce(F.col(label), F.lit("null")), F.lit(" fallback="), F.col("_source_category")
    )
    mismatches = out.where(~valid).select(*df.columns, F.lit("llm_category_mismatch").alias("step"), F.lit("skip").alias("status"), note.alias("error_text"))
    return rows.drop("_source_category"), mismatches


def route(df: DataFrame) -> DataFrame:
    """Outcome of each item: ``status`` and ``last_error``.

    Needs url, raw_content, sentinel, summary_en and summary_zh.  Items that
    fail validation return with status ``retry`` and go through
    :func:`newsiq.plans.queue.after_failure`.
    """
    raw = tx.strip_html(F.coalesce("raw_content", F.lit("")))
    post = F.col("url").contains("x.com") & F.col("url").contains("/status/")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = df.withColumn("_raw", raw)
    reason = (
        F.when(F.col("_raw") == "", "empty raw_content")
        .when(post & ~tx.is_ai_relevant("_raw"), "NOT_AI_RELEVANT")
        .when(F.col("sentinel").isin("INSUFFICIENT_CONTENT", "NOT_AI_RELEVANT"), F.col("sentinel"))
        .when(empty("summary_en") | empty("summary_zh"), "Validation Error: Empty summary field")
    )
    out = out.withColumn("last_error", reason)
    status = F.when(F.col("last_error").isNull(), "done").when(F.col("last_error").startswith("Validation"), "retry").otherwise("error")
    return out.withColumn("status", status).drop("_raw")


def content_for_model(article: Column | str, raw: Column | str, cap: int = 24_000) -> Column:
    """Scraped text when it is longer than 500 characters, else the raw text, up to the model's input size."""
    a = F.coalesce(tx._c(article), F.lit(""))
    return F.substring(F.when(F.length(a) > 500, a).otherwise(tx.strip_html(F.trim(tx._c(raw)))), 1, cap)


def bilingual(df: DataFrame) -> DataFrame:
    """Titles and summaries per language, falling back to the untranslated ones."""
    for lang in ("en", "zh"):
        df = df.withColumn(f"title_{lang}", F.coalesce(f"title_{lang}", "title"))
        df = df.withColumn(f"summary_{lang}", F.coalesce(f"summary_{lang}", "summary"))
    return df
