"""Article analysis: queueing, inputs, validation results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx

INPUT_CAP = 60_000
MIN_CHARS = 500


def prepare(content: Column | str, cap: int = INPUT_CAP) -> Column:
    """Struct (content, input_chars, truncated): squeezed text up to ``cap``, original size kept."""
    text = tx.squeeze(F.coalesce(tx._c(content), F.lit("")))
    return tx.let(
        text,
        lambda v: F.struct(
            F.substring(v, 1, cap).alias("content"),
            F.length(v).cast("long").alias("input_chars"),
            (F.length(v) > cap).alias("truncated"),
        ),
    )


def eligible(content: Column | str) -> Column:
    return F.length(F.trim(F.coalesce(tx._c(content), F.lit("")))) > MIN_CHARS


def enqueue(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Rows to add or change: new articles, and ineligible ones that have grown long enough.

    One left join on the article id decides both.
    """
    now = F.when(eligible("article_content"), "pending").otherwise("ineligible")
    rows = articles.select(F.col("id").alias("article_id"), now.alias("status"))
    old = analysis.select("article_id", F.col("status").alias("old_status"))
    both = rows.join(old, "article_id", "left")
    action = F.when(F.col("old_status").isNull(), "insert").when(
        (F.col("old_status") == "ineligible") & (F.col("status") == "pending"), "requeue"
    )
    return both.withColumn("action", action).where(F.col("action").isNotNull()).drop("old_status")


def next_batch(articles: DataFrame, analysis: DataFrame, n: int) -> DataFrame:
    """Oldest jobs to work on: pending or failed under three times, long enough; ``n`` is the batch size."""
    open_jobs = analysis.where(F.col("status").isin("pending", "error") & (F.col("retry_count") < 3))
    fits = articles.where(F.col("article_content").isNotNull() & (F.length("article_content") > MIN_CHARS))
    jobs = open_jobs.select("analysis_id", "article_id", "retry_count", "created_at").join(
        fits.select(F.col("id").alias("article_id")), "article_id"
    )
    return jobs.orderBy("created_at", "analysis_id").limit(n)


def _facts(block: Column, item) -> Column:
    return F.transform(block["facts"], item)


def to_text(analysis: Column, title: Column | str, cap: int = 8000) -> Column:
    """Fixed layout of a validated analysis, both languages, cut to ``cap``."""
    parts = [
        F.when(F.coalesce(tx._c(title), F.lit("")) != "", F.concat(F.lit("Title: "), tx._c(title))),
        F.concat(F.lit("Article type: "), analysis["article_type"]),
    ]
    for lang in ("en", "zh"):
        block, up = analysis[lang], lang.upper()
        facts = _facts(block, lambda f: F.concat(F.lit("- "), f["text"], F.lit(" ("), f["evidence"], F.lit(")")))
        parts += [
            F.lit(f"{up} facts:"),
            F.nullif(F.array_join(facts, "\n"), F.lit("")),
            F.concat(F.lit(f"{up} why it matters: "), block["why_it_matters"]),
            F.concat(F.lit(f"{up} deeper interpretation: "), block["deeper_interpretation"]),
            F.concat(F.lit(f"{up} limitations: "), F.array_join(block["limitations_or_uncertainties"], " | ")),
        ]
    return F.substring(F.concat_ws("\n", *parts), 1, cap)


def to_prompt(analysis: Column, lang: str) -> Column:
    """Numbered layout of one language of an analysis; empty when it is missing."""
    zh = lang == "zh"
    block = analysis["zh" if zh else "en"]
    label, why, deep, caveats = (
        ("深度分析", "为什么重要", "更深层解读", "限制与不确定性")
        if zh
        else ("Deep Analysis", "Why it matters", "Deeper interpretation", "Limitations and uncertainties")
    )
    fact = lambda f, i: F.when(
        F.coalesce(f["text"], F.lit("")) != "",
        F.concat(
            (i + 1).cast("string"), F.lit(". "), f["text"],
            F.when(F.coalesce(f["evidence"], F.lit("")) != "", F.concat(F.lit(" ("), f["evidence"], F.lit(")"))).otherwise(""),
        ),
    )
    facts = F.array_join(F.array_compact(F.transform(block["facts"], fact)), "\n")
    limits = F.array_join(
        F.transform(block["limitations_or_uncertainties"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )
    z = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(
        F.lit(f"[{label}]\nFacts:\n"), z(facts), F.lit(f"\n\n{why}:\n"), z(block["why_it_matters"]),
        F.lit(f"\n\n{deep}:\n"), z(block["deeper_interpretation"]), F.lit(f"\n\n{caveats}:\n"), z(limits),
    )
    return F.when(block.isNull(), F.lit("")).otherwise(text)
