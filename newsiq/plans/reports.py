"""Monitoring and diagnostic reports.

Child tables are aggregated per key before they are joined, so a parent with
several children is never counted twice.  Report times come in as ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.functions.stats import count_if, distinct_join, object_map, ordered_list, ordered_structs, rate, rate_of
from newsiq.functions.text import has_verification_wall
from newsiq.operators.quantiles import quantiles
from newsiq.operators.windows import latest_per, top_per
from newsiq.plans.evalset import latest_runs
from newsiq.plans.metrics import is_hard_negative

# Lowest metrics and highest latencies a strategy may have.
GATE = {
    "avg_recall_at_5": 0.55, "avg_recall_at_10": 0.70, "avg_mrr": 0.35, "avg_ndcg_at_10": 0.55, "avg_hit_rate_at_5": 0.55,
}
GATE_P50, GATE_P95 = 2500, 8000
# Limits of the canary verdict.
CANARY = {"requests": 20, "p50": 2500, "p95": 8000, "fallback": 0.05, "error": 0.02, "empty": 0.02}
FALLBACK = "chunk_dense_failed_fell_back_to_article_dense"
SOCIAL = ("wechat", "youtube", "reddit")
ANSWER_SURFACE = "answer_question_related_articles"


def _at(as_of: str, back: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {back}")


# ---------------------------------------------------------------- trace inputs

_REWRITE = T.StructType(
    [
        T.StructField("original_query", T.StringType()),
        T.StructField("rewritten_query", T.StringType()),
        T.StructField("rewrite_mode", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("original_vs_rewrite_similarity", T.DoubleType()),
        T.StructField("drift_threshold", T.DoubleType()),
        T.StructField("top_candidate_divergence", T.StringType()),
    ]
)
_INPUT = T.StructType(
    [
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("rerank_metadata", T.StringType()),
        T.StructField("rerank_latency_ms", T.LongType()),
        T.StructField("cold_cache_latency_ms", T.LongType()),
        T.StructField("warm_cache_latency_ms", T.LongType()),
        T.StructField("rewrite_trace", _REWRITE),
        T.StructField("fallback_reason", T.StringType()),
    ]
)


def flatten_query_input(runs: DataFrame, col: str = "query_input") -> DataFrame:
    """Typed columns of the JSON input of a trace, parsed once."""
    out = runs.withColumn("_q", F.from_json(col, _INPUT))
    return out.select(
        *[c for c in runs.columns if c != col],
        F.col("_q.cache_hit").alias("cache_hit"),
        F.col("_q.rerank_metadata").isNotNull().alias("has_rerank"),
        "_q.rerank_latency_ms", "_q.cold_cache_latency_ms", "_q.warm_cache_latency_ms", "_q.fallback_reason",
        F.col("_q.rewrite_trace").isNotNull().alias("has_rewrite"), "_q.rewrite_trace.*",
    )


# ---------------------------------------------------------------- strategies


def _scores(digits: int = 3) -> list[Column]:
    names = ("avg_recall_at_3", "avg_recall_at_5", "avg_recall_at_10", "avg_mrr", "avg_ndcg_at_10", "avg_hit_rate_at_5")
    return [F.round(n, digits).alias(n) for n in names]


def leaderboard(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Newest run per strategy with its gate verdict; metrics are compared after rounding."""
    rows = latest_runs(runs).join(metrics, "run_id").select(
        "run_id", "strategy", "retrieval_version", "created_at", "total_cases", *_scores(), "latency_p50_ms", "latency_p95_ms"
    )
    ok = (F.col("latency_p50_ms") <= GATE_P50) & (F.col("latency_p95_ms") <= GATE_P95)
    for name, least in GATE.items():
        ok = ok & (F.col(name) >= least)
    out = rows.withColumn("gate_status", F.when(ok, "passes_minimum_gate").otherwise("below_gate"))
    return out.orderBy(F.col("gate_status").desc(), F.col("avg_recall_at_10").desc(), F.col("avg_mrr").desc())


def latest_comparison(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Newest run per strategy with its metrics."""
    return latest_runs(runs).join(metrics, "run_id").select(
        "run_id", "eval_set_id", "strategy", "retrieval_version", "total_cases", "approved_gold_count", *_scores(),
        "latency_p50_ms", "latency_p95_ms", "created_at",
    )


def last_runs(runs: DataFrame, metrics: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest runs with their metrics."""
    rows = metrics.join(runs, "run_id").select("run_id", "strategy", "total_cases", *_scores(), "latency_p50_ms", "latency_p95_ms", "created_at")
    return rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)


def newest_run(runs: DataFrame, strategy: str | None = None) -> DataFrame:
    rows = runs if strategy is None else runs.where(F.col("strategy") == strategy)
    return rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(1)


def primary_rank(runs: DataFrame, results: DataFrame, cases: DataFrame, traces: DataFrame, candidates: DataFrame) -> DataFrame:
    """Newest run: rank of each case's own article among its candidates, with metrics and latency."""
    rows = results.join(newest_run(runs).select("run_id"), "run_id", "left_semi").join(
        cases.select("case_id", "primary_article_id"), "case_id"
    )
    rows = rows.join(traces.select(F.col("run_id").alias("retrieval_run_id"), "latency_ms"), "retrieval_run_id")
    own = candidates.groupBy("retrieval_run_id", F.col("article_id").alias("primary_article_id")).agg(F.min("rank").cast("long").alias("primary_rank"))
    out = rows.join(own, ["retrieval_run_id", "primary_article_id"], "left")
    return out.select("case_id", "primary_article_id", "primary_rank", "recall_at_10", "mrr", "ndcg_at_10", "hit_at_5", "latency_ms").orderBy(
        F.col("primary_rank").asc_nulls_first(), "recall_at_10", "mrr"
    )


def candidate_audit(runs: DataFrame, results: DataFrame, candidates: DataFrame, gold: DataFrame, newest_only: bool = True) -> DataFrame:
    """Candidates of the newest run (or of all runs) with their gold labels."""
    rows = results.join(newest_run(runs).select("run_id"), "run_id", "left_semi") if newest_only else results
    rows = rows.select("run_id", "case_id", "retrieval_run_id").join(candidates, "retrieval_run_id")
    labels = gold.select("case_id", "article_id", "relevance_grade", "review_status")
    return rows.join(labels, ["case_id", "article_id"], "left")


def chunk_gold(runs: DataFrame, results: DataFrame, candidates: DataFrame, gold: DataFrame, limit: int = 100) -> DataFrame:
    """Candidates of chunk strategies with gold labels, newest runs first."""
    mine = runs.where(F.col("strategy").startswith("chunk_"))
    rows = candidate_audit(runs, results.join(mine.select("run_id"), "run_id", "left_semi"), candidates, gold, newest_only=False)
    rows = rows.join(mine.select("run_id", "strategy", "created_at"), "run_id")
    return rows.orderBy(F.col("created_at").desc(), "run_id", "case_id", "rank").limit(limit)


def case_movement(runs: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of every case under the newest run of each strategy."""
    rows = latest_runs(runs).select("run_id", "strategy").join(results, "run_id").join(cases.select("case_id", "question"), "case_id")
    return rows.select("case_id", "question", "strategy", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "hit_at_5")


def worst_cases(runs: DataFrame, results: DataFrame, traces: DataFrame, limit: int = 20) -> DataFrame:
    """Worst results of the newest runs."""
    rows = results.join(runs.select("run_id", "created_at"), "run_id").join(
        traces.select(F.col("run_id").alias("retrieval_run_id"), "latency_ms", "candidate_count"), "retrieval_run_id"
    )
    return rows.orderBy(F.col("created_at").desc(), "recall_at_10", "mrr", "run_id", "case_id").limit(limit)


def candidate_noise(runs: DataFrame, results: DataFrame, candidates: DataFrame, limit: int = 50) -> DataFrame:
    """How often each title appears at each rank in the newest run."""
    rows = results.join(newest_run(runs).select("run_id"), "run_id", "left_semi").select("retrieval_run_id").join(candidates, "retrieval_run_id")
    out = rows.groupBy("rank", "title").agg(
        F.count("*").alias("appearances"), F.avg("score_dense").alias("avg_dense"), F.avg("score_lexical").alias("avg_lexical"), F.avg("score_final").alias("avg_final")
    )
    order = [F.col("appearances").desc(), F.col("avg_final").desc_nulls_last(), F.col("avg_dense").desc_nulls_last(), F.col("rank"), F.col("title")]
    return out.orderBy(*order).limit(limit)


def miss_audit(
    runs: DataFrame, results: DataFrame, cases: DataFrame, candidates: DataFrame, gold: DataFrame, news: DataFrame, chunks: DataFrame, strategy: str = "chunk_dense"
) -> DataFrame:
    """Cases of a strategy's newest run that missed gold: what came back, what should have, chunk coverage.

    Candidates, gold and chunks are aggregated apart and joined per case.  The
    lists per case hold its top ten and its few evidence rows.
    """
    rows = results.join(newest_run(runs, strategy).select("run_id"), "run_id", "left_semi")
    found = rows.select("case_id", "retrieval_run_id").join(candidates.where(F.col("article_id").isNotNull()), "retrieval_run_id")
    found = found.groupBy("case_id", "article_id").agg(F.min("rank").alias("rank"), F.max("title").alias("title"), F.max("score_final").alias("score_final"))
    top = found.where(F.col("rank") <= 10).groupBy("case_id").agg(
        ordered_list("article_id", "rank", "article_id").alias("retrieved_top10"),
        ordered_structs([F.col("rank"), F.col("article_id"), F.col("title"), F.col("score_final")], "rank", "article_id").alias("retrieved_top10_detail"),
    )
    target = gold.where((F.col("review_status") == "approved") & (F.col("relevance_grade") >= 2))
    target = target.join(rows.select("case_id"), "case_id", "left_semi").join(news.select(F.col("id").alias("article_id"), F.col("title").alias("gold_title")), "article_id")
    cover = chunks.groupBy("article_id").agg(F.count("*").alias("chunks"), count_if(F.col("embedding").isNotNull()).alias("embedded_chunks"))
    target = target.join(cover, "article_id", "left").join(found.select("case_id", "article_id", F.col("rank").alias("gold_rank")), ["case_id", "article_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = [-F.col("relevance_grade"), F.col("created_at"), F.col("article_id")]
    wanted = target.groupBy("case_id").agg(
        ordered_list("article_id", *order).alias("approved_gold"),
        ordered_structs([F.col("article_id"), F.col("gold_title").alias("title"), F.col("relevance_grade"), F.col("review_status")], *order).alias("approved_gold_detail"),
        F.min("gold_rank").alias("best_gold_rank"),
        ordered_list("article_id", "article_id", where=F.col("gold_rank").isNull()).alias("missing_approved_gold"),
        ordered_structs([F.col("article_id"), zero("chunks").alias("chunks"), zero("embedded_chunks").alias("embedded_chunks")], "article_id").alias("gold_chunk_coverage"),
    )
    none = F.array().cast("array<bigint>")
    out = rows.where(F.col("recall_at_10") < 1).join(cases.select("case_id", "question", "primary_article_id"), "case_id")
    out = out.join(top, "case_id", "left").join(wanted, "case_id", "left")
    for c in ("retrieved_top10", "approved_gold", "missing_approved_gold"):
        out = out.withColumn(c, F.coalesce(F.col(c), none))
    return out.orderBy("recall_at_10", F.col("best_gold_rank").asc_nulls_first(), "mrr")


def hard_negative_wins(runs: DataFrame, results: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases where a hard negative outranks the best relevant article in a strategy's newest run."""
    rows = latest_runs(runs).select("run_id", "strategy").join(results.select("run_id", "case_id", "retrieval_run_id"), "run_id")
    rows = rows.join(candidates.select("retrieval_run_id", "article_id", "rank"), "retrieval_run_id")
    rows = rows.join(gold.select("case_id", "article_id", "relevance_grade", "evidence_role"), ["case_id", "article_id"], "left")
    hard = is_hard_negative()
    out = rows.groupBy("strategy", "case_id").agg(
        F.min(F.when((F.col("relevance_grade") >= 2) & ~hard, F.col("rank"))).alias("best_gold_rank"),
        F.min(F.when(hard, F.col("rank"))).alias("best_hard_negative_rank"),
        ordered_list("article_id", "rank", where=hard).alias("ranked_hard_negative_article_ids"),
    )
    better = F.col("best_gold_rank").isNull() | (F.col("best_hard_negative_rank") < F.col("best_gold_rank"))
    return out.where(F.col("best_hard_negative_rank").isNotNull() & better)


# ---------------------------------------------------------------- evaluation set


def eval_set_summary(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases and evidence counts per evaluation set."""
    per_case = gold.groupBy("case_id").agg(
        F.count("*").alias("gold_rows"), count_if(F.col("review_status") == "pending").alias("pending_gold"),
        count_if(F.col("review_status") == "approved").alias("approved_gold"), count_if(F.col("relevance_grade") >= 2).alias("relevant_gold"),
    )
    names = ("gold_rows", "pending_gold", "approved_gold", "relevant_gold")
    rows = cases.select("case_id", "eval_set_id").join(per_case, "case_id", "left")
    return rows.groupBy("eval_set_id").agg(F.countDistinct("case_id").alias("cases"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def gold_review(gold: DataFrame, cases: DataFrame, news: DataFrame, limit: int = 20) -> DataFrame:
    """Pending evidence to check, best grades first; the queue length is the feature."""
    rows = gold.where(F.col("review_status") == "pending").select("case_id", "article_id", "relevance_grade", "evidence_role")
    rows = rows.join(cases.select("case_id", "question", "lang", "cohort", "created_at"), "case_id")
    rows = rows.orderBy(F.col("relevance_grade").desc(), F.col("created_at").desc(), "case_id", "article_id").limit(limit)
    return rows.join(news.select(F.col("id").alias("article_id"), F.col("title").alias("article_title")), "article_id")


def related_targets(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Approved relevant evidence per case, apart from and including the baseline article."""
    good = gold.where((F.col("review_status") == "approved") & (F.col("relevance_grade") >= 2))
    base = F.coalesce("source", F.lit("")) == "primary_article_baseline"
    per_case = good.groupBy("case_id").agg(count_if(~base).alias("approved_related_targets"), count_if(base).alias("approved_primary_targets"))
    out = cases.select("case_id", "primary_article_id").join(per_case, "case_id", "left")
    return out.fillna(0, ["approved_related_targets", "approved_primary_targets"])


def gold_readiness(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases per set with approved, only pending, or no relevant evidence."""
    rel = gold.where(F.col("relevance_grade") >= 2).groupBy("case_id").agg(
        count_if(F.col("review_status") == "approved").alias("a"), count_if(F.col("review_status") == "pending").alias("p")
    )
    rows = cases.select("case_id", "eval_set_id").join(rel, "case_id", "left").fillna(0, ["a", "p"])
    return rows.groupBy("eval_set_id").agg(
        F.count("*").alias("total_cases"), count_if(F.col("a") > 0).alias("cases_with_approved_relevant_gold"),
        count_if((F.col("a") == 0) & (F.col("p") > 0)).alias("cases_with_only_pending_relevant_gold"),
        count_if((F.col("a") == 0) & (F.col("p") == 0)).alias("cases_without_relevant_gold"),
    )


def cases_missing_gold(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases whose best approved grade is below 2."""
    best = gold.groupBy("case_id").agg(F.max(F.when(F.col("review_status") == "approved", F.col("relevance_grade"))).alias("max_approved_grade"), F.count("*").alias("labels"))
    out = cases.select("case_id", "primary_article_id").join(best, "case_id", "left").fillna(0, ["labels"])
    return out.where(F.coalesce("max_approved_grade", F.lit(0)) < 2)


def taxonomy_slices(runs: DataFrame, results: DataFrame, tagged: DataFrame) -> DataFrame:
    """Metrics of each strategy's newest run per taxonomy slice and tag; small slices are directional.

    Cases without a tag appear in no slice.
    """
    rows = latest_runs(runs).select("run_id", "strategy").join(results, "run_id")
    slices = tagged.select("case_id", "format_cohort", "source_type", "question_type", "entity_density", F.explode("difficulty_tags").alias("difficulty_tag"))
    out = rows.join(slices, "case_id").groupBy("run_id", "strategy", "format_cohort", "source_type", "question_type", "entity_density", "difficulty_tag").agg(
        F.count("*").alias("total_cases"),
        *[F.avg(m).alias(f"avg_{m}") for m in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")],
        F.avg(F.col("hit_at_5").cast("double")).alias("avg_hit_at_5"),
    )
    return out.withColumn("slice_status", F.when(F.col("total_cases") < 5, "directional_n_lt_5").otherwise("reviewable"))


def generation_scores(results: DataFrame) -> DataFrame:
    """Mean judge scores per mode and models."""
    names = ("faithfulness", "relevancy", "context_precision", "context_recall")
    return results.groupBy("mode", "answer_model", "judge_model").agg(F.count("*").alias("rows"), *[F.avg(n).alias(f"avg_{n}") for n in names])


def agentic_slices(traces: DataFrame) -> DataFrame:
    """Cases, rounds, loop violations and latency per intent."""
    out = traces.groupBy("intent").agg(
        F.countDistinct("case_id").alias("slice_n"), F.max("retrieval_round").cast("long").alias("max_retrieval_round"),
        count_if(F.col("retrieval_round") > 2).alias("loop_safety_violations"), F.avg("latency_ms").alias("avg_latency_ms"),
    )
    return out.withColumn("interpretation", F.when(F.col("slice_n") >= 5, "eligible_for_pass_fail").otherwise("directional_only"))


# ---------------------------------------------------------------- sources and corpus


def weak_answers(qa: DataFrame, news: DataFrame, traces: DataFrame, as_of: str, limit: int | None = 50) -> DataFrame:
    """Questions of the last 30 days with negative feedback, no candidates or no related articles."""
    rows = qa.where(F.col("asked_at") > _at(as_of, "30 DAYS"))
    rows = rows.join(news.select(F.col("id").alias("article_id"), "title"), "article_id")
    rows = rows.join(traces.select(F.col("run_id").alias("rag_retrieval_run_id"), "candidate_count", "injected_count", "latency_ms"), "rag_retrieval_run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rows = rows.where(F.coalesce(F.col("feedback") == -1, F.lit(False)) | zero("candidate_count") | zero("related_count"))
    out = rows.orderBy(F.col("asked_at").desc(), F.col("qa_log_id").desc())
    return out.limit(limit) if limit else out


def new_case_candidates(news: DataFrame, sources: DataFrame, cases: DataFrame, as_of: str, limit: int | None = 100) -> DataFrame:
    """Articles of the last 21 days that are no case yet, by source type and recency."""
    rows = news.where(F.col("created_at") > _at(as_of, "21 DAYS")).join(cases.select(F.col("primary_article_id").alias("id")), "id", "left_anti")
    rows = rows.join(sources.select("source_id", F.col("name").alias("source_name"), "source_type"), "source_id")
    preview = F.substring(F.coalesce("summary_zh", "summary", "summary_en", "article_content", F.lit("")), 1, 800)
    out = rows.select(F.col("id").alias("article_id"), "title", "source_name", "source_type", "created_at", preview.alias("evidence_preview"))
    out = out.orderBy("source_type", F.col("created_at").desc(), "article_id")
    return out.limit(limit) if limit else out


def _watched(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("is_active") & F.col("source_type").isin(*SOCIAL))


def social_candidates(sources: DataFrame, raw: DataFrame, news: DataFrame, cases: DataFrame, as_of: str, per_source: int = 5) -> DataFrame:
    """Funnel of social sources: recent raw rows, best articles and a six-way status."""
    recent = F.col("fetched_at") > _at(as_of, "24 HOURS")
    raws = raw.groupBy("source_id").agg(
        count_if(recent).alias("raw_24h"), count_if(recent & (F.col("status") == "done")).alias("raw_done_24h"),
        count_if(recent & (F.col("status") == "error")).alias("raw_error_24h"), F.max("fetched_at").alias("newest_raw"),
        distinct_join("last_error", where=recent & F.col("last_error").isNotNull()).alias("recent_errors"),
    )
    text = F.coalesce("article_content", "summary_zh", "summary", "summary_en", F.lit(""))
    arts = news.where(F.col("created_at") > _at(as_of, "14 DAYS")).join(cases.select(F.col("primary_article_id").alias("id")), "id", "left_anti")
    arts = arts.select(
        "source_id", F.col("id").alias("article_id"), "title", "created_at", F.length(F.coalesce("article_content", F.lit(""))).cast("long").alias("article_chars"),
        F.substring(text, 1, 800).alias("evidence_preview"), has_verification_wall(text).alias("walled"),
    )
    arts = top_per(arts, ["source_id"], [F.col("article_chars").desc(), F.col("created_at").desc(), F.col("article_id")], per_source)
    rows = _watched(sources).select("source_id", "name", "source_type").join(raws, "source_id", "left").join(arts, "source_id", "left")
    rows = rows.fillna(0, ["raw_24h", "raw_done_24h", "raw_error_24h"])
    status = (
        F.when(F.coalesce("walled", F.lit(False)), "blocked_verification_wall")
        .when(F.col("article_id").isNotNull() & (F.col("article_chars") >= 800), "ready_for_eval_json")
        .when(F.col("raw_24h") == 0, "no_recent_raw_ingestion")
        .when(F.col("raw_done_24h") == 0, "raw_not_processed_to_done")
        .when(F.col("article_id").isNull(), "no_recent_daily_news_article")
        .otherwise("article_too_short")
    )
    return rows.withColumn("candidate_status", status).drop("walled")


def freshness(sources: DataFrame, raw: DataFrame, news: DataFrame, as_of: str) -> DataFrame:
    """Newest raw and processed row of each watched source and a status."""
    raws = raw.groupBy("source_id").agg(F.max("fetched_at").alias("newest_raw_row_at"), count_if(F.col("fetched_at") >= _at(as_of, "24 HOURS")).alias("raw_rows_last_24h"))
    arts = news.groupBy("source_id").agg(F.max("created_at").alias("newest_processed_at"), count_if(F.col("created_at") >= _at(as_of, "48 HOURS")).alias("processed_rows_last_48h"))
    rows = _watched(sources).select("source_id", "name", "source_type").join(raws, "source_id", "left").join(arts, "source_id", "left")
    rows = rows.fillna(0, ["raw_rows_last_24h", "processed_rows_last_48h"])
    status = (
        F.when(F.col("newest_raw_row_at").isNull(), "never_succeeded")
        .when(F.col("newest_raw_row_at") < _at(as_of, "48 HOURS"), "stale_success")
        .when(F.col("newest_processed_at").isNull(), "no_processed_articles")
        .otherwise("healthy")
    )
    return rows.withColumn("freshness_status", status)


def analysis_readiness(news: DataFrame, analysis: DataFrame, as_of: str) -> DataFrame:
    """One row of analysis backlog counts."""
    rows = news.select(F.col("id").alias("article_id"), F.length(F.coalesce("article_content", F.lit(""))).alias("chars")).join(analysis, "article_id", "left")
    is_ = lambda s: F.col("status") == s
    return rows.agg(
        count_if((F.col("chars") > 500) & is_("ready")).alias("eligible_ready_count"), count_if(is_("pending")).alias("pending"),
        count_if(is_("processing") & (F.col("updated_at") < _at(as_of, "15 MINUTES"))).alias("processing_stale"),
        count_if(is_("error") & (F.coalesce("retry_count", F.lit(0)) < 3)).alias("retryable_errors"),
        count_if(is_("ineligible") & (F.col("chars") <= 500)).alias("short_or_empty_ineligible"),
    )


def gold_chunk_coverage(gold: DataFrame, chunks: DataFrame, version: str, model: str) -> DataFrame:
    """Chunk and embedded-chunk counts of every approved relevant article."""
    wanted = gold.where((F.col("review_status") == "approved") & (F.col("relevance_grade") >= 2)).select("article_id").distinct()
    mine = F.col("chunking_version") == version
    cover = chunks.groupBy("article_id").agg(
        count_if(mine).alias("chunk_count"), count_if(mine & (F.col("embedding_model") == model) & F.col("embedding").isNotNull()).alias("embedded_chunk_count")
    )
    return wanted.join(cover, "article_id", "left").fillna(0, ["chunk_count", "embedded_chunk_count"])


def corpus_health(
    gold: DataFrame, chunks: DataFrame, sources: DataFrame, raw: DataFrame, news: DataFrame, analysis: DataFrame, as_of: str, version: str, model: str
) -> DataFrame:
    """One row: coverage, stale sources, backlog, chunk counts per version and readiness flags."""
    cover = gold_chunk_coverage(gold, chunks, version, model).agg(
        count_if(F.col("chunk_count") == 0).alias("zero_chunk_gold_articles"),
        count_if((F.col("chunk_count") > 0) & (F.col("embedded_chunk_count") == 0)).alias("missing_embedding_gold_articles"),
    )
    stale = freshness(sources, raw, news, as_of).agg(
        count_if(F.col("newest_processed_at").isNull() | (F.col("newest_raw_row_at").isNull() & (F.col("raw_rows_last_24h") == 0))).alias("stale_source_count")
    )
    backlog = analysis_readiness(news, analysis, as_of)
    versions = chunks.groupBy("chunking_version").agg(F.count("*").alias("n")).agg(F.to_json(object_map("chunking_version", "n")).alias("chunk_count_by_version"))
    # one-row tables, read as scalars
    one = lambda df, c: df.select(c).scalar().alias(c)
    out = cover.select("*", one(stale, "stale_source_count"), *[one(backlog, c) for c in backlog.columns], one(versions, "chunk_count_by_version"))
    ready = (F.col("zero_chunk_gold_articles") == 0) & (F.col("missing_embedding_gold_articles") == 0) & (F.col("stale_source_count") == 0)
    return out.withColumn("ready_for_replay", ready)


def zero_chunk_gold(cases: DataFrame, gold: DataFrame, news: DataFrame, raw: DataFrame, sources: DataFrame, chunks: DataFrame, version: str, model: str) -> DataFrame:
    """Approved relevant evidence without an embedded chunk of the required version, and why."""
    wanted = gold.where((F.col("review_status") == "approved") & ~is_hard_negative() & (F.col("relevance_grade") >= 2))
    rows = wanted.select("case_id", "article_id", "relevance_grade").join(cases.select("case_id"), "case_id", "left_semi")
    length = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    info = news.select(
        F.col("id").alias("article_id"), "raw_ingestion_id", "source_id", F.col("published_at").alias("_p"),
        length(F.col("article_content")).alias("article_content_chars"), length(F.coalesce("summary_en", "summary_zh", "summary")).alias("summary_chars"),
    )
    rows = rows.join(info, "article_id")
    rows = rows.join(raw.select(F.col("id").alias("raw_ingestion_id"), F.col("published_at").alias("_r")), "raw_ingestion_id", "left")
    rows = rows.join(sources.select("source_id", "source_type"), "source_id", "left")
    per_version = chunks.groupBy("article_id", "chunking_version").agg(
        F.count("*").alias("chunk_count"), count_if((F.col("embedding_model") == model) & F.col("embedding").isNotNull()).alias("embedded_chunk_count")
    )
    # an article has as many entries as there are chunking versions
    packed = per_version.groupBy("article_id").agg(ordered_structs([F.col("chunking_version"), F.col("chunk_count"), F.col("embedded_chunk_count")], "chunking_version").alias("chunk_versions"))
    rows = rows.join(packed, "article_id", "left")
    fine = F.exists("chunk_versions", lambda e: (e["chunking_version"] == version) & (e["embedded_chunk_count"] > 0))
    rows = rows.where(~F.coalesce(fine, F.lit(False)))
    none = F.col("chunk_versions").isNull()
    reason = (
        F.when(none & (F.col("article_content_chars") == 0) & (F.col("summary_chars") == 0), "missing_article_text")
        .when(none & (F.col("article_content_chars") < 200), "below_default_chunk_backfill_min_chars")
        .when(none, "needs_chunk_backfill")
        .otherwise("missing_required_chunking_or_embedding")
    )
    return rows.withColumn("published_at", F.coalesce("_p", "_r")).withColumn("invalid_reason", reason).drop("_p", "_r", "raw_ingestion_id")


# ---------------------------------------------------------------- production


def canary(runs: DataFrame, qa: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Last day of answers per strategy: volume, exact percentiles, rates and verdict."""
    rows = runs.where((F.col("surface") == ANSWER_SURFACE) & (F.col("created_at") >= _at(as_of, f"{int(hours)} HOURS")))
    logs = qa.select(F.col("rag_retrieval_run_id").alias("run_id"), "error_message", "feedback")
    rows = rows.join(logs, "run_id", "left").withColumn("fallback_reason", F.get_json_object("query_input", "$.fallback_reason"))
    by = rows.groupBy("strategy", "retriever_name").agg(
        F.count("*").alias("requests"),
        rate(F.col("injected_count") == 0).alias("empty"), rate(F.col("error_message").isNotNull()).alias("error"),
        F.coalesce(rate_of(F.col("feedback") < 0, F.col("feedback").isNotNull()), F.lit(0.0)).alias("negative"),
        rate(F.col("fallback_reason") == FALLBACK).alias("fallback"),
    )
    latency = quantiles(rows, ["strategy", "retriever_name"], {"p50": ("latency_ms", 0.5, "cont"), "p95": ("latency_ms", 0.95, "cont")})
    same = [F.col(f"by.{c}").eqNullSafe(F.col(f"lat.{c}")) for c in ("strategy", "retriever_name")]
    by = by.alias("by").join(latency.alias("lat"), same[0] & same[1]).select("by.*", "p50", "p95")
    mine = F.col("strategy") == "chunk_dense_bge_m3"
    passed = (
        (F.col("requests") >= CANARY["requests"]) & (F.col("p50") <= CANARY["p50"]) & (F.col("p95") <= CANARY["p95"])
        & (F.col("fallback") <= CANARY["fallback"]) & (F.col("error") <= CANARY["error"]) & (F.col("empty") <= CANARY["empty"])
    )
    verdict = (
        F.when(mine & passed, "canary_gate_pass").when(mine, "canary_gate_watch")
        .when(F.col("strategy") == "dense_article_similarity_prefer_deep_analysis", "rollback_or_fallback_path").otherwise("unknown_strategy")
    )
    return by.select(
        "strategy", "retriever_name", "requests", F.round("p50", 0).alias("p50_latency_ms"), F.round("p95", 0).alias("p95_latency_ms"),
        F.round("empty", 4).alias("empty_candidate_rate"), F.round("error", 4).alias("qa_error_rate"),
        F.round("negative", 4).alias("negative_feedback_rate"), F.round("fallback", 4).alias("fallback_rate"), verdict.alias("production_gate_status"),
    )


def rerank_latency(runs: DataFrame) -> DataFrame:
    """Exact rerank latency percentiles per strategy and cache state."""
    rows = flatten_query_input(runs).where("has_rerank")
    return quantiles(rows, ["strategy", "cache_hit"], {
        "rerank_p50_ms": ("rerank_latency_ms", 0.5, "cont"), "rerank_p95_ms": ("rerank_latency_ms", 0.95, "cont"),
        "cold_cache_p95_ms": ("cold_cache_latency_ms", 0.95, "cont"), "warm_cache_p95_ms": ("warm_cache_latency_ms", 0.95, "cont"),
    })


def rewrites(runs: DataFrame) -> DataFrame:
    """Every recorded query rewrite."""
    return flatten_query_input(runs).where("has_rewrite").select(
        "run_id", "strategy", "created_at", "original_query", "rewritten_query", "rewrite_mode", "accepted", "reject_reason"
    )


def rejected_rewrites(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rejected rewrites with the ids of their first ten candidates."""
    rows = rewrites(runs).where(~F.coalesce("accepted", F.lit(False)))
    top = candidates.where(F.col("rank") <= 10).groupBy(F.col("retrieval_run_id").alias("run_id")).agg(ordered_list("article_id", "rank").alias("top10_candidate_article_ids"))
    return rows.join(top, "run_id", "left")


def trace_integrity(runs: DataFrame, as_of: str) -> DataFrame:
    """Trace counts per surface over seven days."""
    rows = runs.where(F.col("created_at") > _at(as_of, "7 DAYS"))
    return rows.groupBy("surface").agg(
        F.count("*").alias("runs"), F.count("qa_log_id").alias("linked_qa_logs"), F.count("trend_brief_key").alias("linked_trend_briefs"),
        F.sum("candidate_count").alias("candidates_recorded"), F.sum("injected_count").alias("injected_contexts_recorded"),
        F.round(F.avg("latency_ms")).alias("avg_retrieval_latency_ms"),
    )


def latest_traces(qa: DataFrame, runs: DataFrame, surface: str = ANSWER_SURFACE, limit: int = 5) -> DataFrame:
    """Newest answers with their trace header."""
    heads = runs.where(F.col("surface") == surface).select(F.col("run_id").alias("rag_retrieval_run_id"), "surface", "strategy", "candidate_count", "injected_count", "latency_ms")
    return qa.join(heads, "rag_retrieval_run_id").orderBy(F.col("asked_at").desc(), F.col("qa_log_id").desc()).limit(limit)


def content_depth(raw: DataFrame, sources: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Substantive and title-only raw rows per source."""
    rows = raw.where(F.col("fetched_at") > _at(as_of, f"{int(days)} DAYS")).join(sources.select("source_id", "name"), "source_id")
    n = F.length("raw_content")
    return rows.groupBy("name").agg(count_if(n > 500).alias("substantive"), count_if(n <= 200).alias("title_only"))


def category_matrix(news: DataFrame, sources: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Article category against source category, with the number of rows."""
    rows = news.where(F.col("created_at") > _at(as_of, f"{int(days)} DAYS")).select("source_id", F.col("category").alias("llm_category"))
    rows = rows.join(sources.select("source_id", F.col("category").alias("source_category")), "source_id")
    out = rows.groupBy("llm_category", "source_category").agg(F.count("*").alias("rows"))
    return out.withColumn("matches_source_default", F.col("llm_category") == F.col("source_category"))


def null_categories(news: DataFrame) -> DataFrame:
    return news.agg(count_if(F.col("category").isNull()).alias("null_category_rows"))


def step_runs(events: DataFrame) -> DataFrame:
    """Per run and step: counts by status, durations and error rate."""
    return events.groupBy("run_id", "step").agg(
        F.count("*").alias("events"), *[count_if(F.col("status") == s).alias(s) for s in ("ok", "skip", "error")],
        F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.avg((F.col("status") == "error").cast("double")).alias("error_rate"),
    )


def feedback_counts(votes: DataFrame) -> DataFrame:
    """Up and down votes per target, each user's latest vote only; 0 withdraws a vote."""
    last = latest_per(votes, ["user_id", "target_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return last.groupBy("target_id").agg(count_if(F.col("feedback") == 1).alias("up_count"), count_if(F.col("feedback") == -1).alias("down_count"))
