"""Prompt contexts and retrieval traces built from ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsiq.functions.stats import ordered_list

MAIN_CAP, RELATED_CAP, PACK_CAP, MAX_RELATED = 12_000, 800, 16_000, 3


def disposition(candidates: DataFrame, primary: str = "primary_article_id", max_related: int = MAX_RELATED) -> DataFrame:
    """Mark the injected candidates and say why the others were dropped.

    The primary article never competes; of the rest the first ``max_related``
    by rank are injected.
    """
    own = F.col("article_id").eqNullSafe(F.col(primary))
    w = Window.partitionBy("query_id", own).orderBy("rank")
    out = candidates.withColumn("_pos", F.row_number().over(w))
    injected = ~own & (F.col("_pos") <= max_related)
    reason = F.when(injected, F.lit(None).cast("string")).when(own, "primary_article_excluded").otherwise("rank_beyond_context_cap")
    return out.withColumn("injected", injected).withColumn("drop_reason", reason).drop("_pos")


def history_disposition(candidates: DataFrame, cap: int = 8) -> DataFrame:
    """The same for historical context: candidates carry ``selected`` and ``in_window``.

    Candidates are looked at by rank until ``cap`` were taken; later ones are
    not evaluated.
    """
    eligible = ~F.col("selected") & ~F.col("in_window")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    out = candidates.withColumn("_taken", F.coalesce(F.sum(eligible.cast("int")).over(w), F.lit(0)))
    reason = (
        F.when(F.col("_taken") >= cap, "not_evaluated_after_context_cap")
        .when(F.col("selected"), "current_window_selected")
        .when(F.col("in_window"), "current_window_article")
    )
    out = out.withColumn("drop_reason", reason).withColumn("injected", reason.isNull())
    return out.drop("_taken")


def related_context(candidates: DataFrame, max_related: int = MAX_RELATED, cap: int = RELATED_CAP) -> DataFrame:
    """(query_id, related_context, injected_ids): the injected candidates as numbered blocks."""
    kept = disposition(candidates, max_related=max_related).where("injected")
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = kept.withColumn("_n", F.row_number().over(w))
    label = F.when(F.col("lang") == "zh", "相关文章").otherwise("Related article")
    block = F.concat(
        F.lit("["), label, F.lit(" "), F.col("_n").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")),
        F.lit("\n"), F.substring(F.coalesce("context", F.lit("")), 1, cap),
    )
    return kept.groupBy("query_id").agg(
        F.concat(F.lit("\n\n"), F.array_join(ordered_list(block, "_n"), "\n\n")).alias("related_context"),
        F.array_join(ordered_list(F.col("article_id").cast("string"), "_n"), ",").alias("injected_ids"),
        F.count("*").alias("injected_count"),
    )


def main_context(content: Column, summary: Column, analysis: Column, questions: Column, cap: int = MAIN_CAP) -> Column:
    """Sections of the primary article: analysis, compact summary with reader questions, raw text."""
    raw = F.substring(F.coalesce(F.nullif(content, F.lit("")), summary, F.lit("")), 1, cap)
    compact = F.concat(
        F.lit("[Compact summary]\n"),
        F.coalesce(summary, F.lit("")),
        F.when(F.coalesce(questions, F.lit("")) != "", F.concat(F.lit("\n\n[Reader questions]\n"), questions)).otherwise(""),
    )
    return F.concat_ws("\n\n", F.nullif(analysis, F.lit("")), compact, F.concat(F.lit("[Raw article content]\n"), raw))


def pack(candidates: DataFrame, limit: int = 10, cap: int = PACK_CAP) -> DataFrame:
    """One context per query: title and text of the first ``limit`` candidates, hashed.

    ``limit`` and ``cap`` are what the context holds by definition.
    """
    kept = candidates.where(F.col("rank") <= limit)
    block = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("context"), F.lit("")))
    text = F.substring(F.array_join(ordered_list(block, "rank"), "\n\n"), 1, cap)
    out = kept.groupBy("query_id").agg(
        text.alias("context_text"),
        F.array_join(ordered_list(F.col("article_id").cast("string"), "rank"), ",").alias("article_ids"),
    )
    return out.select(
        "*",
        F.sha2("context_text", 256).alias("context_hash"),
        F.length("context_text").cast("long").alias("context_chars"),
    )


def trace(results: DataFrame, strategy: str, retriever: str, match_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, candidate and context rows of a retrieval result.

    ``results`` has query_id, question, lang, primary_article_id, article_id,
    rank, title, context and score_final.
    """
    marked = disposition(results)
    candidates = marked.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "article_id", "title",
        F.substring(F.coalesce("context", F.lit("")), 1, 1000).alias("summary_excerpt"),
        "score_final", "injected", "drop_reason",
    )
    contexts = related_context(results).select(
        "query_id",
        F.lit(2).cast("long").alias("ordinal"),
        F.lit("answer_question_related_context").alias("context_role"),
        F.col("related_context").alias("context_text"),
        F.sha2("related_context", 256).alias("context_hash"),
        F.length("related_context").cast("long").alias("context_chars"),
    )
    counts = marked.groupBy("query_id").agg(
        F.first("question").alias("query_text"),
        F.count("*").alias("candidate_count"),
        F.count_if("injected").alias("injected_count"),
    )
    header = counts.join(contexts.select("query_id", "context_chars"), "query_id", "left").select(
        "query_id", "query_text", F.lit(strategy).alias("retrieval_strategy"), F.lit(retriever).alias("retriever_name"),
        F.lit(match_count).cast("long").alias("match_count"), "candidate_count", "injected_count",
        F.coalesce("context_chars", F.lit(0)).cast("long").alias("context_total_chars"),
    )
    return header, candidates, contexts
