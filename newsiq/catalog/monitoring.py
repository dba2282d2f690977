"""Catalog: monitoring and diagnostic reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.relational import READINESS
from newsiq.catalog.tables import AS_OF
from newsiq.plans import reports as rp

TS = f"TIMESTAMP '{AS_OF}'"
LATEST = "latest AS (SELECT DISTINCT ON (strategy) * FROM eval_runs ORDER BY strategy, created_at DESC, run_id DESC)"
NEWEST = "newest AS (SELECT run_id FROM eval_runs ORDER BY created_at DESC, run_id DESC LIMIT 1)"
_M = ("avg_recall_at_3", "avg_recall_at_5", "avg_recall_at_10", "avg_mrr", "avg_ndcg_at_10", "avg_hit_rate_at_5")
SCORES = ", ".join(f"round({m}, 3) AS {m}" for m in _M)


@query(
    "rep_1_leaderboard",
    f"""WITH {LATEST}, r AS (SELECT l.run_id, l.strategy, l.retrieval_version, l.created_at, m.total_cases, {SCORES}, m.latency_p50_ms, m.latency_p95_ms FROM latest l JOIN metrics m USING (run_id))
      SELECT *, CASE WHEN avg_recall_at_5 >= 0.55 AND avg_recall_at_10 >= 0.70 AND avg_mrr >= 0.35 AND avg_ndcg_at_10 >= 0.55 AND avg_hit_rate_at_5 >= 0.55 AND latency_p50_ms <= 2500 AND latency_p95_ms <= 8000
        THEN 'passes_minimum_gate' ELSE 'below_gate' END AS gate_status FROM r""",
    ("eval_runs", "metrics"),
)
def leaderboard(t):
    return rp.leaderboard(t.eval_runs, t.metrics)


@query(
    "rep_2_latest_comparison",
    f"WITH {LATEST} SELECT l.run_id, l.eval_set_id, l.strategy, l.retrieval_version, m.total_cases, CAST(m.approved_gold_count AS BIGINT) AS approved_gold_count, {SCORES}, m.latency_p50_ms, m.latency_p95_ms, l.created_at FROM latest l JOIN metrics m USING (run_id)",
    ("eval_runs", "metrics"),
)
def latest_comparison(t):
    return rp.latest_comparison(t.eval_runs, t.metrics)


@query(
    "rep_2_last_runs",
    f"SELECT r.run_id, r.strategy, m.total_cases, {SCORES}, m.latency_p50_ms, m.latency_p95_ms, r.created_at FROM metrics m JOIN eval_runs r USING (run_id) ORDER BY r.created_at DESC, r.run_id DESC LIMIT 10",
    ("eval_runs", "metrics"),
)
def last_runs(t):
    return rp.last_runs(t.eval_runs, t.metrics)


@query(
    "rep_3_primary_rank",
    f"""WITH {NEWEST} SELECT c.case_id, c.primary_article_id, min(k.rank) FILTER (WHERE k.article_id = c.primary_article_id) AS primary_rank, r.recall_at_10, r.mrr, r.ndcg_at_10, r.hit_at_5, x.latency_ms
      FROM newest JOIN case_results r USING (run_id) JOIN cases c USING (case_id) JOIN runs x ON x.run_id = r.retrieval_run_id LEFT JOIN candidates k ON k.retrieval_run_id = x.run_id GROUP BY ALL""",
    ("eval_runs", "case_results", "cases", "runs", "candidates"),
)
def primary_rank(t):
    return rp.primary_rank(t.eval_runs, t.case_results, t.cases, t.runs, t.candidates)


@query(
    "rep_3_candidate_audit",
    """SELECT r.run_id, r.case_id, k.rank, k.article_id, k.title, k.score_final, g.relevance_grade, g.review_status FROM case_results r JOIN candidates k USING (retrieval_run_id) LEFT JOIN gold g ON g.case_id = r.case_id AND g.article_id = k.article_id""",
    ("case_results", "candidates", "gold"),
)
def candidate_audit(t):
    out = rp.candidate_audit(t.eval_runs, t.case_results, t.candidates, t.gold, newest_only=False)
    return out.select("run_id", "case_id", F.col("rank").cast("long").alias("rank"), "article_id", "title", "score_final", "relevance_grade", "review_status")


@query(
    "rep_3_chunk_gold",
    """SELECT r.run_id, r.case_id, e.strategy, k.rank, k.article_id, g.relevance_grade FROM eval_runs e JOIN case_results r USING (run_id) JOIN candidates k USING (retrieval_run_id) LEFT JOIN gold g ON g.case_id = r.case_id AND g.article_id = k.article_id
      WHERE e.strategy LIKE 'chunk#_%' ESCAPE '#' ORDER BY e.created_at DESC, r.run_id, r.case_id, k.rank LIMIT 100""",
    ("eval_runs", "case_results", "candidates", "gold"),
)
def chunk_gold(t):
    out = rp.chunk_gold(t.eval_runs, t.case_results, t.candidates, t.gold)
    return out.select("run_id", "case_id", "strategy", F.col("rank").cast("long").alias("rank"), "article_id", "relevance_grade")


@query(
    "rep_3_case_movement",
    f"WITH {LATEST} SELECT c.case_id, c.question, l.strategy, r.recall_at_5, r.recall_at_10, r.mrr, r.ndcg_at_10, r.hit_at_5 FROM latest l JOIN case_results r USING (run_id) JOIN cases c USING (case_id)",
    ("eval_runs", "case_results", "cases"),
)
def case_movement(t):
    return rp.case_movement(t.eval_runs, t.case_results, t.cases)


@query(
    "rep_3_worst_cases",
    """SELECT r.run_id, r.case_id, r.recall_at_10, r.mrr, x.latency_ms, x.candidate_count FROM case_results r JOIN eval_runs e USING (run_id) JOIN runs x ON x.run_id = r.retrieval_run_id
      ORDER BY e.created_at DESC, r.recall_at_10, r.mrr, r.run_id, r.case_id LIMIT 20""",
    ("case_results", "eval_runs", "runs"),
)
def worst_cases(t):
    return rp.worst_cases(t.eval_runs, t.case_results, t.runs).select("run_id", "case_id", "recall_at_10", "mrr", "latency_ms", "candidate_count")


@query(
    "rep_4_candidate_noise",
    f"""WITH {NEWEST} SELECT k.rank, k.title, count(*) AS appearances, round(avg(k.score_dense), 6) AS avg_dense, round(avg(k.score_lexical), 6) AS avg_lexical, round(avg(k.score_final), 6) AS avg_final
      FROM newest JOIN case_results r USING (run_id) JOIN candidates k USING (retrieval_run_id) GROUP BY 1, 2 ORDER BY count(*) DESC, avg(k.score_final) DESC NULLS LAST, avg(k.score_dense) DESC NULLS LAST, k.rank, k.title LIMIT 50""",
    ("eval_runs", "case_results", "candidates"),
)
def candidate_noise(t):
    out = rp.candidate_noise(t.eval_runs, t.case_results, t.candidates)
    return out.select(F.col("rank").cast("long").alias("rank"), "title", "appearances", *[F.round(c, 6).alias(c) for c in ("avg_dense", "avg_lexical", "avg_final")])


@query(
    "rep_5_miss_audit",
    f"""WITH newest AS (SELECT run_id FROM eval_runs WHERE strategy = 'chunk_dense' ORDER BY created_at DESC, run_id DESC LIMIT 1),
      res AS (SELECT * FROM case_results JOIN newest USING (run_id)), f AS (SELECT r.case_id, k.article_id, min(k.rank) AS rank FROM res r JOIN candidates k USING (retrieval_run_id) GROUP BY 1, 2),
      top AS (SELECT case_id, string_agg(article_id, ',' ORDER BY rank, article_id) FILTER (WHERE rank <= 10) AS retrieved FROM f GROUP BY 1),
      g AS (SELECT g.* FROM gold g JOIN news n ON n.id = g.article_id WHERE g.review_status = 'approved' AND g.relevance_grade >= 2),
      cov AS (SELECT article_id, count(*) AS c, count(embedding) AS e FROM chunks GROUP BY 1),
      w AS (SELECT g.case_id, string_agg(g.article_id, ',' ORDER BY g.relevance_grade DESC, g.created_at, g.article_id) AS gold, min(f.rank) AS best_gold_rank, coalesce(string_agg(g.article_id, ',' ORDER BY g.article_id) FILTER (WHERE f.rank IS NULL), '') AS missing,
        string_agg(g.article_id || ':' || coalesce(c, 0) || '/' || coalesce(e, 0), ',' ORDER BY g.article_id) AS coverage FROM g LEFT JOIN f ON f.case_id = g.case_id AND f.article_id = g.article_id LEFT JOIN cov ON cov.article_id = g.article_id GROUP BY 1)
      SELECT c.case_id, c.primary_article_id, r.recall_at_10, coalesce(top.retrieved, '') AS retrieved, coalesce(w.gold, '') AS gold, w.best_gold_rank, coalesce(w.missing, '') AS missing, coalesce(w.coverage, '') AS coverage
      FROM res r JOIN cases c USING (case_id) LEFT JOIN top USING (case_id) LEFT JOIN w USING (case_id) WHERE r.recall_at_10 < 1""",
    ("eval_runs", "case_results", "cases", "candidates", "gold", "news", "chunks"),
)
def miss_audit(t):
    out = rp.miss_audit(t.eval_runs, t.case_results, t.cases, t.candidates, t.gold, t.news, t.chunks)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias
    cover = F.transform("gold_chunk_coverage", lambda e: F.concat(e["article_id"].cast("string"), F.lit(":"), e["chunks"].cast("string"), F.lit("/"), e["embedded_chunks"].cast("string")))
    return out.select(
        "case_id", "primary_article_id", "recall_at_10", join("retrieved_top10")("retrieved"), join("approved_gold")("gold"),
        F.col("best_gold_rank").cast("long").alias("best_gold_rank"), join("missing_approved_gold")("missing"), F.coalesce(F.array_join(cover, ","), F.lit("")).alias("coverage"),
    )


@query(
    "rep_6_eval_set_summary",
    """SELECT c.eval_set_id, count(DISTINCT c.case_id) AS cases, count(g.article_id) AS gold_rows, count(*) FILTER (WHERE g.review_status = 'pending') AS pending_gold, count(*) FILTER (WHERE g.review_status = 'approved') AS approved_gold,
      count(*) FILTER (WHERE g.relevance_grade >= 2) AS relevant_gold FROM cases c LEFT JOIN gold g USING (case_id) GROUP BY 1""",
    ("cases", "gold"),
)
def eval_set_summary(t):
    return rp.eval_set_summary(t.cases, t.gold)


@query(
    "rep_6_gold_review",
    "SELECT c.case_id, g.article_id, c.question, a.title AS article_title, g.relevance_grade FROM (SELECT g.*, c.created_at AS ca FROM gold g JOIN cases c USING (case_id) WHERE review_status = 'pending' ORDER BY relevance_grade DESC, c.created_at DESC, case_id, article_id LIMIT 20) g JOIN cases c USING (case_id) JOIN news a ON a.id = g.article_id",
    ("cases", "gold", "news"),
)
def gold_review(t):
    return rp.gold_review(t.gold, t.cases, t.news).select("case_id", "article_id", "question", "article_title", "relevance_grade")


@query(
    "rep_6_related_targets",
    """SELECT c.case_id, c.primary_article_id, count(*) FILTER (WHERE g.review_status = 'approved' AND g.relevance_grade >= 2 AND coalesce(g.source, '') <> 'primary_article_baseline') AS approved_related_targets,
      count(*) FILTER (WHERE g.review_status = 'approved' AND g.relevance_grade >= 2 AND g.source = 'primary_article_baseline') AS approved_primary_targets FROM cases c LEFT JOIN gold g USING (case_id) GROUP BY 1, 2""",
    ("cases", "gold"),
)
def related_targets(t):
    return rp.related_targets(t.cases, t.gold)


@query("rep_6_gold_readiness", READINESS, ("cases", "gold"))
def gold_readiness(t):
    return rp.gold_readiness(t.cases, t.gold)


@query(
    "rep_7_weak_answers",
    f"""SELECT q.qa_log_id, q.article_id, n.title, q.question, q.feedback, q.related_count, r.candidate_count, r.injected_count, r.latency_ms, q.asked_at FROM qa_logs q JOIN news n ON n.id = q.article_id LEFT JOIN runs r ON r.run_id = q.rag_retrieval_run_id
      WHERE q.asked_at > {TS} - INTERVAL '30' DAY AND (q.feedback = -1 OR coalesce(r.candidate_count, 0) = 0 OR coalesce(q.related_count, 0) = 0)""",
    ("qa_logs", "news", "runs"),
)
def weak_answers(t):
    out = rp.weak_answers(t.qa_logs, t.news, t.runs, AS_OF, limit=None)
    return out.select("qa_log_id", "article_id", "title", "question", F.col("feedback").cast("long").alias("feedback"), "related_count", "candidate_count", "injected_count", "latency_ms", "asked_at").withColumn(
        "feedback", F.col("feedback").cast("int")
    )


@query(
    "rep_8_new_case_candidates",
    f"""SELECT n.id AS article_id, n.title, s.name AS source_name, s.source_type, n.created_at, substr(coalesce(n.summary_zh, n.summary, n.summary_en, n.article_content, ''), 1, 800) AS evidence_preview FROM news n JOIN sources s USING (source_id)
      WHERE n.created_at > {TS} - INTERVAL '21' DAY AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.primary_article_id = n.id)""",
    ("news", "sources", "cases"),
)
def new_case_candidates(t):
    return rp.new_case_candidates(t.news, t.sources, t.cases, AS_OF, limit=None)


@query(
    "rep_9_social_candidates",
    f"""WITH rr AS (SELECT source_id, count(*) FILTER (WHERE fetched_at > {TS} - INTERVAL '24' HOUR) AS raw_24h, count(*) FILTER (WHERE status = 'done' AND fetched_at > {TS} - INTERVAL '24' HOUR) AS raw_done_24h,
        count(*) FILTER (WHERE status = 'error' AND fetched_at > {TS} - INTERVAL '24' HOUR) AS raw_error_24h, max(fetched_at) AS newest_raw,
        string_agg(DISTINCT substr(last_error, 1, 180), ' | ' ORDER BY substr(last_error, 1, 180)) FILTER (WHERE fetched_at > {TS} - INTERVAL '24' HOUR) AS recent_errors FROM raw GROUP BY 1),
      ra AS (SELECT * FROM (SELECT source_id, id AS article_id, title, length(coalesce(article_content, '')) AS article_chars, row_number() OVER (PARTITION BY source_id ORDER BY length(coalesce(article_content, '')) DESC, created_at DESC, id) AS rn
        FROM news n WHERE created_at > {TS} - INTERVAL '14' DAY AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.primary_article_id = n.id)) z WHERE rn <= 5)
      SELECT s.name, s.source_type, coalesce(raw_24h, 0) AS raw_24h, coalesce(raw_done_24h, 0) AS raw_done_24h, coalesce(raw_error_24h, 0) AS raw_error_24h, newest_raw, recent_errors, ra.article_id, ra.article_chars,
        CASE WHEN ra.article_id IS NOT NULL AND ra.article_chars >= 800 THEN 'ready_for_eval_json' WHEN coalesce(raw_24h, 0) = 0 THEN 'no_recent_raw_ingestion' WHEN coalesce(raw_done_24h, 0) = 0 THEN 'raw_not_processed_to_done'
          WHEN ra.article_id IS NULL THEN 'no_recent_daily_news_article' ELSE 'article_too_short' END AS candidate_status
      FROM sources s LEFT JOIN rr USING (source_id) LEFT JOIN ra USING (source_id) WHERE s.source_type IN ('wechat', 'youtube', 'reddit') AND s.is_active""",
    ("sources", "raw", "news", "cases"),
)
def social_candidates(t):
    out = rp.social_candidates(t.sources, t.raw, t.news, t.cases, AS_OF)
    return out.select("name", "source_type", "raw_24h", "raw_done_24h", "raw_error_24h", "newest_raw", "recent_errors", "article_id", "article_chars", "candidate_status")


FRESH = f"""fresh AS (SELECT s.source_id, s.name, s.source_type, r.newest_raw_row_at, coalesce(r.n, 0) AS raw_rows_last_24h, a.newest_processed_at, coalesce(a.n, 0) AS processed_rows_last_48h,
    CASE WHEN r.newest_raw_row_at IS NULL THEN 'never_succeeded' WHEN r.newest_raw_row_at < {TS} - INTERVAL '48' HOUR THEN 'stale_success' WHEN a.newest_processed_at IS NULL THEN 'no_processed_articles' ELSE 'healthy' END AS freshness_status
  FROM sources s LEFT JOIN (SELECT source_id, max(fetched_at) AS newest_raw_row_at, count(*) FILTER (WHERE fetched_at >= {TS} - INTERVAL '24' HOUR) AS n FROM raw GROUP BY 1) r USING (source_id)
  LEFT JOIN (SELECT source_id, max(created_at) AS newest_processed_at, count(*) FILTER (WHERE created_at >= {TS} - INTERVAL '48' HOUR) AS n FROM news GROUP BY 1) a USING (source_id)
  WHERE s.is_active AND s.source_type IN ('wechat', 'reddit', 'youtube'))"""


@query("rep_10_freshness", f"WITH {FRESH} SELECT * FROM fresh", ("sources", "raw", "news"))
def freshness(t):
    return rp.freshness(t.sources, t.raw, t.news, AS_OF)


@query(
    "rep_11_corpus_health",
    f"""WITH {FRESH}, g AS (SELECT DISTINCT article_id FROM gold WHERE review_status = 'approved' AND relevance_grade >= 2),
      cc AS (SELECT g.article_id, count(c.chunk_id) FILTER (WHERE c.chunking_version = 'v1') AS n, count(*) FILTER (WHERE c.chunking_version = 'v1' AND c.embedding_model = 'm1' AND c.embedding IS NOT NULL) AS e FROM g LEFT JOIN chunks c USING (article_id) GROUP BY 1),
      x AS (SELECT count(*) FILTER (WHERE n = 0) AS z, count(*) FILTER (WHERE n > 0 AND e = 0) AS m FROM cc), st AS (SELECT count(*) AS s FROM fresh WHERE newest_processed_at IS NULL OR (newest_raw_row_at IS NULL AND raw_rows_last_24h = 0)),
      ad AS (SELECT count(*) FILTER (WHERE a.status = 'pending') AS p, count(*) FILTER (WHERE a.status = 'error' AND coalesce(a.retry_count, 0) < 3) AS r FROM news n LEFT JOIN analysis a ON a.article_id = n.id),
      v AS (SELECT '{{' || string_agg('"' || chunking_version || '":' || n, ',' ORDER BY chunking_version) || '}}' AS j FROM (SELECT chunking_version, count(*) AS n FROM chunks GROUP BY 1) q)
      SELECT z AS zero_chunk_gold_articles, m AS missing_embedding_gold_articles, s AS stale_source_count, p AS pending, r AS retryable_errors, j AS chunk_count_by_version, z = 0 AND m = 0 AND s = 0 AS ready_for_replay FROM x, st, ad, v""",
    ("sources", "raw", "news", "gold", "chunks", "analysis"),
)
def corpus_health(t):
    out = rp.corpus_health(t.gold, t.chunks, t.sources, t.raw, t.news, t.analysis, AS_OF, "v1", "m1")
    return out.select("zero_chunk_gold_articles", "missing_embedding_gold_articles", "stale_source_count", "pending", "retryable_errors", "chunk_count_by_version", "ready_for_replay")


@query(
    "rep_12_zero_chunk_gold",
    """WITH c AS (SELECT article_id, chunking_version, count(*) AS n, count(*) FILTER (WHERE embedding_model = 'other' AND embedding IS NOT NULL) AS e FROM chunks GROUP BY 1, 2)
      SELECT g.case_id, g.article_id, s.source_type, coalesce(n.published_at, r.published_at) AS published_at, length(coalesce(n.article_content, '')) AS article_content_chars,
        CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.article_id = g.article_id) THEN CASE WHEN length(coalesce(n.article_content, '')) = 0 AND length(coalesce(n.summary_en, n.summary_zh, n.summary, '')) = 0 THEN 'missing_article_text'
          WHEN length(coalesce(n.article_content, '')) < 200 THEN 'below_default_chunk_backfill_min_chars' ELSE 'needs_chunk_backfill' END ELSE 'missing_required_chunking_or_embedding' END AS invalid_reason
      FROM gold g JOIN cases USING (case_id) JOIN news n ON n.id = g.article_id LEFT JOIN raw r ON r.id = n.raw_ingestion_id LEFT JOIN sources s ON s.source_id = n.source_id
      WHERE g.review_status = 'approved' AND g.evidence_role IS DISTINCT FROM 'hard_negative' AND g.relevance_grade >= 2 AND NOT EXISTS (SELECT 1 FROM c WHERE c.article_id = g.article_id AND c.chunking_version = 'v1' AND c.e > 0)""",
    ("chunks", "gold", "cases", "news", "raw", "sources"),
)
def zero_chunk_gold(t):
    # the rarer of the two embedding models leaves gaps to report
    out = rp.zero_chunk_gold(t.cases, t.gold, t.news, t.raw, t.sources, t.chunks, "v1", "other")
    return out.select("case_id", "article_id", "source_type", "published_at", "article_content_chars", "invalid_reason")


@query(
    "rep_13_canary",
    """WITH r AS (SELECT r.*, q.error_message, q.feedback FROM runs r LEFT JOIN qa_logs q ON q.rag_retrieval_run_id = r.run_id WHERE r.surface = 'answer_question_related_articles' AND r.created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '24' HOUR * 10),
      b AS (SELECT strategy, retriever_name, count(*) AS requests, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, avg(CASE WHEN injected_count = 0 THEN 1 ELSE 0 END) AS e, avg(CASE WHEN error_message IS NOT NULL THEN 1 ELSE 0 END) AS q,
        coalesce(avg(CASE WHEN feedback < 0 THEN 1 ELSE 0 END) FILTER (WHERE feedback IS NOT NULL), 0) AS n, avg(CASE WHEN json_extract_string(query_input, '$.fallback_reason') = 'chunk_dense_failed_fell_back_to_article_dense' THEN 1 ELSE 0 END) AS f FROM r GROUP BY 1, 2)
      SELECT strategy, retriever_name, requests, round(p50, 0) AS p50_latency_ms, round(p95, 0) AS p95_latency_ms, round(e, 4) AS empty_candidate_rate, round(q, 4) AS qa_error_rate, round(n, 4) AS negative_feedback_rate, round(f, 4) AS fallback_rate,
        CASE WHEN strategy = 'chunk_dense_bge_m3' AND requests >= 20 AND p50 <= 2500 AND p95 <= 8000 AND f <= 0.05 AND q <= 0.02 AND e <= 0.02 THEN 'canary_gate_pass' WHEN strategy = 'chunk_dense_bge_m3' THEN 'canary_gate_watch'
          WHEN strategy = 'dense_article_similarity_prefer_deep_analysis' THEN 'rollback_or_fallback_path' ELSE 'unknown_strategy' END AS production_gate_status FROM b""",
    ("runs", "qa_logs"),
)
def canary(t):
    return rp.canary(t.runs, t.qa_logs, AS_OF, hours=240)


_J = lambda k, ty="BIGINT": f"CAST(json_extract_string(query_input, '$.{k}') AS {ty})"


@query(
    "rep_14_rerank_latency",
    f"""SELECT strategy, {_J('cache_hit', 'BOOLEAN')} AS cache_hit, quantile_cont({_J('rerank_latency_ms')}, 0.5) AS rerank_p50_ms, quantile_cont({_J('rerank_latency_ms')}, 0.95) AS rerank_p95_ms, quantile_cont({_J('cold_cache_latency_ms')}, 0.95) AS cold_cache_p95_ms,
      quantile_cont({_J('warm_cache_latency_ms')}, 0.95) AS warm_cache_p95_ms FROM runs WHERE json_exists(query_input, '$.rerank_metadata') GROUP BY 1, 2""",
    ("runs",),
)
def rerank_latency(t):
    return rp.rerank_latency(t.runs)


@query(
    "rep_14_rewrites",
    "SELECT run_id, strategy, created_at, json_extract_string(query_input, '$.rewrite_trace.original_query') AS original_query, json_extract_string(query_input, '$.rewrite_trace.rewritten_query') AS rewritten_query, json_extract_string(query_input, '$.rewrite_trace.rewrite_mode') AS rewrite_mode, CAST(json_extract_string(query_input, '$.rewrite_trace.accepted') AS BOOLEAN) AS accepted, json_extract_string(query_input, '$.rewrite_trace.reject_reason') AS reject_reason FROM runs WHERE json_exists(query_input, '$.rewrite_trace')",
    ("runs",),
)
def rewrites(t):
    return rp.rewrites(t.runs)


@query(
    "rep_14_rejected_rewrites",
    """SELECT r.run_id, r.strategy, json_extract_string(r.query_input, '$.rewrite_trace.reject_reason') AS reject_reason, (SELECT string_agg(c.article_id, ',' ORDER BY c.rank) FROM candidates c WHERE c.retrieval_run_id = r.run_id AND c.rank <= 10) AS top10
      FROM runs r WHERE json_exists(r.query_input, '$.rewrite_trace') AND NOT CAST(json_extract_string(r.query_input, '$.rewrite_trace.accepted') AS BOOLEAN)""",
    ("runs", "candidates"),
)
def rejected_rewrites(t):
    out = rp.rejected_rewrites(t.runs, t.candidates)
    return out.select("run_id", "strategy", "reject_reason", F.array_join(F.transform("top10_candidate_article_ids", lambda x: x.cast("string")), ",").alias("top10"))


@query(
    "rep_15_trace_integrity",
    f"""SELECT surface, count(*) AS runs, count(*) FILTER (WHERE qa_log_id IS NOT NULL) AS linked_qa_logs, count(*) FILTER (WHERE trend_brief_key IS NOT NULL) AS linked_trend_briefs, CAST(sum(candidate_count) AS BIGINT) AS candidates_recorded,
      CAST(sum(injected_count) AS BIGINT) AS injected_contexts_recorded, round(avg(latency_ms)) AS avg_retrieval_latency_ms FROM runs WHERE created_at > {TS} - INTERVAL '7' DAY GROUP BY surface""",
    ("runs",),
)
def trace_integrity(t):
    return rp.trace_integrity(t.runs, AS_OF)


@query(
    "rep_15_latest_traces",
    """SELECT q.qa_log_id, q.question, r.surface, r.strategy, r.candidate_count, r.injected_count FROM qa_logs q JOIN runs r ON r.run_id = q.rag_retrieval_run_id WHERE r.surface = 'answer_question_related_articles' ORDER BY q.asked_at DESC, q.qa_log_id DESC LIMIT 5""",
    ("qa_logs", "runs"),
)
def latest_traces(t):
    return rp.latest_traces(t.qa_logs, t.runs).select("qa_log_id", "question", "surface", "strategy", "candidate_count", "injected_count")


@query(
    "rep_16_content_depth",
    f"SELECT s.name, count(*) FILTER (WHERE length(r.raw_content) > 500) AS substantive, count(*) FILTER (WHERE length(r.raw_content) <= 200) AS title_only FROM raw r JOIN sources s USING (source_id) WHERE r.fetched_at > {TS} - INTERVAL '30' DAY GROUP BY 1",
    ("raw", "sources"),
)
def content_depth(t):
    return rp.content_depth(t.raw, t.sources, AS_OF, days=30)


@query(
    "rep_16_category_matrix",
    f"""SELECT n.category AS llm_category, s.category AS source_category, count(*) AS rows, n.category = s.category AS matches_source_default FROM news n JOIN sources s USING (source_id) WHERE n.created_at > {TS} - INTERVAL '30' DAY GROUP BY 1, 2""",
    ("news", "sources"),
)
def category_matrix(t):
    return rp.category_matrix(t.news, t.sources, AS_OF, days=30)


@query(
    "rep_17_step_runs",
    """SELECT run_id, step, count(*) AS events, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'skip') AS skip, count(*) FILTER (WHERE status = 'error') AS error, round(avg(duration_ms), 6) AS avg_duration_ms, max(duration_ms) AS max_duration_ms,
      round(avg(CASE WHEN status = 'error' THEN 1 ELSE 0 END), 6) AS error_rate FROM step_events GROUP BY 1, 2""",
    ("step_events",),
)
def step_runs(t):
    out = rp.step_runs(t.step_events)
    return out.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6)).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "rep_hard_negative_wins",
    f"""WITH {LATEST}, j AS (SELECT l.strategy, r.case_id, k.rank, k.article_id, g.relevance_grade, g.evidence_role FROM latest l JOIN case_results r USING (run_id) JOIN candidates k USING (retrieval_run_id) LEFT JOIN gold g ON g.case_id = r.case_id AND g.article_id = k.article_id),
      a AS (SELECT strategy, case_id, min(rank) FILTER (WHERE relevance_grade >= 2 AND evidence_role IS DISTINCT FROM 'hard_negative') AS best_gold_rank, min(rank) FILTER (WHERE evidence_role = 'hard_negative') AS best_hard_negative_rank,
        string_agg(article_id, ',' ORDER BY rank) FILTER (WHERE evidence_role = 'hard_negative') AS ids FROM j GROUP BY 1, 2)
      SELECT * FROM a WHERE best_hard_negative_rank IS NOT NULL AND (best_gold_rank IS NULL OR best_hard_negative_rank < best_gold_rank)""",
    ("eval_runs", "case_results", "candidates", "gold"),
)
def hard_negative_wins(t):
    out = rp.hard_negative_wins(t.eval_runs, t.case_results, t.candidates, t.gold)
    return out.select(
        "strategy", "case_id", F.col("best_gold_rank").cast("long").alias("best_gold_rank"), F.col("best_hard_negative_rank").cast("long").alias("best_hard_negative_rank"),
        F.array_join(F.transform("ranked_hard_negative_article_ids", lambda x: x.cast("string")), ",").alias("ids"),
    )
