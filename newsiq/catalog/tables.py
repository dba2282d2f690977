"""Reference-shaped tables derived from the driver tables.

Each derived table is one SELECT in SQL that Spark and DuckDB both accept;
the few spots where the dialects differ go through :class:`Dialect`.  The
Spark side runs the text over the parquet scans, the SQL side chains the same
texts as CTEs, so both engines read identical rows.  Every derived table reads
all rows of its driver tables and whole texts (titles are the first 80
characters, as a title is).  Two tables leave out children on purpose, so that
outer and anti joins meet missing ones: ``analysis`` has none for every fourth
article and ``qa_logs`` none for every eighth run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from newsiq.session import configure

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Dialect:
    """The places where the two SQL dialects disagree."""

    spark: bool

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.spark else f"TIMESTAMP '{text}'"

    def series(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))" if self.spark else f"unnest(generate_series({lo}, {hi}))"

    def split(self, text: str, sep: str) -> str:
        return f"split({text}, '{sep}')" if self.spark else f"string_split({text}, '{sep}')"

    def day(self, ts: str) -> str:
        return f"CAST({ts} AS DATE)"


SPARK, DUCK = Dialect(True), Dialect(False)


def _minute(expr: str) -> str:
    return f"({expr}) * INTERVAL '1' MINUTE"


# name -> (tables read, SQL builder)
DERIVED: dict[str, tuple[tuple[str, ...], object]] = {
    "sources": (
        ("documents",),
        lambda d: """
        SELECT source_id, concat('src', CAST(source_id AS string)) AS name,
          concat('https://', CASE source_id % 4 WHEN 0 THEN 'www.youtube.com/@Handle' WHEN 1 THEN 'openai.example.com/feed'
                 WHEN 2 THEN 'anthropic.example.com/rss' ELSE 'news.example.com/rss/' END, CAST(source_id AS string)) AS rss_url,
          CASE source_id % 8 WHEN 0 THEN 'rss' WHEN 1 THEN 'wechat' WHEN 2 THEN 'reddit' WHEN 3 THEN 'youtube'
               WHEN 4 THEN 'official_rss' WHEN 5 THEN 'apify_tweet' WHEN 6 THEN 'aihot' ELSE 'arxiv' END AS source_type,
          CASE source_id % 3 WHEN 0 THEN 'industry' WHEN 1 THEN 'technical_frontier' ELSE 'career_community' END AS category,
          source_id % 10 <> 9 AS is_active,
          concat('handle', CAST(source_id AS string)) AS handle,
          CASE WHEN source_id % 2 = 0 THEN concat('bio of ', CAST(source_id AS string)) END AS bio
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS source_id FROM documents) x""",
    ),
    # messy feed items: tracked and repeated URLs
    "items": (
        ("documents",),
        lambda d: f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id,
          concat('https://ex.org/a/', CAST(doc_id - CASE WHEN doc_id % 10 = 9 THEN 4 ELSE 0 END AS string),
                 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '?utm_source=x&b=2&ref=h'
                      WHEN 3 THEN '/index.html#top' ELSE '?UTM_Medium=m' END) AS url,
          substr(text, 1, 80) AS title, text AS body,
          {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 7919) % 43200 - 60 * (doc_id % 48)')} AS published_at,
          CASE WHEN doc_id % 3 = 0 THEN 'official' ELSE 'secondary' END AS trust_tier,
          CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 0 END AS dedupe_priority
        FROM documents""",
    ),
    "news": (
        ("documents",),
        lambda d: f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, doc_id AS raw_ingestion_id,
          concat('https://ex.org/a/', CAST(doc_id AS string)) AS url,
          substr(text, 1, 80) AS title,
          CASE WHEN lang = 'en' THEN substr(text, 1, 80) END AS title_en,
          CASE WHEN lang <> 'en' THEN substr(text, 1, 80) END AS title_zh,
          text AS summary,
          CASE WHEN lang = 'en' THEN text END AS summary_en,
          CASE WHEN lang <> 'en' THEN text END AS summary_zh,
          CASE WHEN doc_id % 7 <> 0 THEN text END AS article_content,
          CASE WHEN doc_id % 4 = 0 THEN concat('q', CAST(doc_id AS string)) END AS questions,
          CASE WHEN doc_id % 5 <> 0 THEN {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 7919) % 43200 - 60 * (doc_id % 48)')} END AS published_at,
          {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 7919) % 43200')} AS created_at,
          CASE doc_id % 3 WHEN 0 THEN 'industry' WHEN 1 THEN 'technical_frontier' ELSE 'career_community' END AS category,
          CASE WHEN doc_id % 6 = 5 THEN NULL ELSE (doc_id * 7919) % 500 END AS likes,
          CASE WHEN doc_id % 6 = 5 THEN (doc_id * 31) % 90 END AS score
        FROM documents""",
    ),
    "raw": (
        ("documents",),
        lambda d: f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id,
          concat('https://ex.org/a/', CAST(doc_id AS string)) AS url, text AS raw_content,
          CASE WHEN doc_id % 7 IN (0, 1) THEN 'pending' WHEN doc_id % 7 = 2 THEN 'error' ELSE 'done' END AS status,
          doc_id % 4 AS retry_count,
          CASE WHEN doc_id % 7 = 2 THEN CASE WHEN doc_id % 3 <> 0 THEN 'INSUFFICIENT_CONTENT' ELSE concat('timeout ', CAST(doc_id % 3 AS string)) END END AS last_error,
          CASE WHEN doc_id % 5 <> 0 THEN {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 7919) % 43200 - 60 * (doc_id % 48)')} END AS published_at,
          {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 7919) % 43200 - 10')} AS fetched_at
        FROM documents""",
    ),
    "analysis": (
        ("documents",),
        lambda d: f"""
        SELECT doc_id AS analysis_id, doc_id AS article_id,
          CASE doc_id % 6 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'error' ELSE 'ineligible' END AS status,
          doc_id % 5 AS retry_count,
          {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 104729) % 43200')} AS created_at,
          {d.ts('2024-01-01 00:00:00')} + {_minute('(doc_id * 1299709) % 43200')} AS updated_at
        FROM documents WHERE doc_id % 4 <> 3""",
    ),
    "chunks": (
        ("embeddings",),
        lambda d: """
        SELECT vec_id AS chunk_id, CAST(floor(vec_id / 5) AS BIGINT) AS article_id, vec_id % 5 AS chunk_index,
          CASE WHEN vec_id % 29 = 28 THEN NULL ELSE embedding END AS embedding,
          CASE WHEN vec_id % 10 = 7 THEN 'other' ELSE 'm1' END AS embedding_model,
          CASE WHEN vec_id % 13 = 12 THEN 'v0' ELSE 'v1' END AS chunking_version, label
        FROM embeddings""",
    ),
    # one vector per article, and the analysis vectors, of which the ready ones replace it
    "article_vectors": (
        ("embeddings",),
        lambda d: """
        SELECT vec_id AS article_id, embedding FROM embeddings""",
    ),
    "analysis_vectors": (
        ("embeddings",),
        lambda d: """
        SELECT vec_id + 3 AS article_id, embedding,
          CASE WHEN vec_id % 3 = 0 THEN 'pending' ELSE 'ready' END AS status
        FROM embeddings""",
    ),
    "cases": (
        ("benchmark", "embeddings"),
        lambda d: f"""
        SELECT b.item_id AS case_id, b.item_id % 2 AS eval_set_id, b.text AS question,
          CASE WHEN b.item_id % 5 = 4 THEN 'zh' ELSE 'en' END AS lang,
          CASE WHEN b.item_id % 3 = 0 THEN 'long' ELSE 'mid' END AS cohort,
          CASE b.item_id % 4 WHEN 0 THEN 'comparison' WHEN 1 THEN 'temporal' ELSE 'factual' END AS case_type,
          CASE b.item_id % 3 WHEN 0 THEN 'production_badcase' WHEN 1 THEN 'manual' ELSE 'eval_json' END AS case_source,
          CAST(floor(b.item_id / 5) AS BIGINT) AS primary_article_id,
          e.embedding AS query_embedding, e.label AS label,
          {d.ts('2024-01-10 00:00:00')} + {_minute('(b.item_id * 37) % 4320')} AS created_at
        FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id""",
    ),
    "gold": (
        ("benchmark", "embeddings"),
        lambda d: f"""
        SELECT case_id, article_id, max(grade) AS relevance_grade,
          CASE WHEN (case_id + article_id) % 4 = 3 THEN 'pending' ELSE 'approved' END AS review_status,
          CASE WHEN max(grade) = 0 THEN 'hard_negative' END AS evidence_role,
          CASE WHEN article_id = CAST(floor(case_id / 5) AS BIGINT) THEN 'primary_article_baseline' ELSE 'expanded' END AS source,
          {d.ts('2024-01-12 00:00:00')} + {_minute('(case_id * 131 + article_id * 17) % 4320')} AS created_at
        FROM (SELECT q.item_id AS case_id, CAST(floor(e.vec_id / 5) AS BIGINT) AS article_id,
                CASE WHEN e.label = qe.label THEN CASE WHEN e.vec_id % 4 = 0 THEN 1 ELSE 2 + e.vec_id % 2 END ELSE 0 END AS grade
              FROM benchmark q JOIN embeddings qe ON q.item_id = qe.vec_id
              JOIN embeddings e ON CAST(floor(e.vec_id / 50) AS BIGINT) = CAST(floor(qe.vec_id / 50) AS BIGINT)
              WHERE e.label = qe.label OR e.vec_id % 11 = 0) g
        GROUP BY case_id, article_id""",
    ),
    "eval_runs": (
        ("events",),
        lambda d: """
        SELECT user_id AS run_id, user_id % 2 AS eval_set_id, 'v1' AS retrieval_version,
          CASE user_id % 5 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'chunk_dense' ELSE 'chunk_hybrid' END AS strategy,
          CASE user_id % 3 WHEN 0 THEN 'plain note' WHEN 1 THEN concat('{"notes_schema_version":"rag-eval-run-notes-v1","valid_for_strategy_selection":true,"corpus_health_run_id":"', CAST(user_id AS string), '"}')
               ELSE '{"gold_policy":"approved_only"}' END AS notes,
          min(ts) AS created_at
        FROM events GROUP BY user_id""",
    ),
    "case_results": (
        ("events",),
        lambda d: """
        SELECT user_id AS run_id, event_id % 40 AS case_id, min(event_id) AS retrieval_run_id,
          (min(event_id) % 5) / 4e0 AS recall_at_3, (min(event_id) % 4) / 3e0 AS recall_at_5, (min(event_id) % 3) / 2e0 AS recall_at_10,
          1e0 / (1 + min(event_id) % 6) AS mrr, (min(event_id) % 9) / 8e0 AS ndcg_at_10, min(event_id) % 4 > 0 AS hit_at_5
        FROM events GROUP BY user_id, event_id % 40""",
    ),
    "metrics": (
        ("events",),
        lambda d: """
        SELECT user_id AS run_id, count(*) AS total_cases, sum(event_id % 3) AS approved_gold_count,
          avg((event_id % 5) / 4e0) AS avg_recall_at_3, avg((event_id % 4) / 3e0) AS avg_recall_at_5, avg((event_id % 3) / 2e0) AS avg_recall_at_10,
          avg(1e0 / (1 + event_id % 6)) AS avg_mrr, avg((event_id % 9) / 8e0) AS avg_ndcg_at_10,
          avg(CASE WHEN event_id % 4 > 0 THEN 1e0 ELSE 0e0 END) AS avg_hit_rate_at_5,
          max(CAST(floor(value) AS BIGINT)) * 4 AS latency_p50_ms, max(CAST(floor(value) AS BIGINT)) * 17 AS latency_p95_ms
        FROM events GROUP BY user_id""",
    ),
    "candidates": (
        ("events",),
        lambda d: f"""
        SELECT retrieval_run_id, rank, article_id, CASE WHEN article_id % 3 = 0 THEN 'chunk' ELSE 'article' END AS candidate_type,
          concat('title ', CAST(article_id % 20 AS string)) AS title,
          CASE WHEN rank % 4 = 0 THEN NULL ELSE 1e0 / (rank + article_id % 3) END AS score_dense,
          CASE WHEN rank % 3 = 0 THEN 2e0 / rank END AS score_lexical, 1e0 / rank AS score_final
        FROM (SELECT event_id AS retrieval_run_id, rank, (event_id * 7 + rank * rank * 3) % 100 AS article_id
              FROM (SELECT event_id, {d.series('1', '6')} AS rank FROM events) r) c""",
    ),
    "runs": (
        ("events",),
        lambda d: """
        SELECT event_id AS run_id, ts AS created_at, user_id,
          CASE WHEN event_id % 5 = 4 THEN 'trend_brief_historical_enrichment' ELSE 'answer_question_related_articles' END AS surface,
          CASE event_type WHEN 'click' THEN 'chunk_dense_bge_m3' WHEN 'view' THEN 'dense_article_similarity_prefer_deep_analysis' ELSE concat('strategy_', event_type) END AS strategy,
          concat('retriever_', CAST(event_id % 2 AS string)) AS retriever_name,
          CAST(floor(value * 20) AS BIGINT) AS latency_ms, event_id % 7 AS candidate_count, event_id % 6 AS injected_count,
          CASE WHEN event_id % 5 <> 4 AND event_id % 3 <> 0 THEN event_id END AS qa_log_id,
          CASE WHEN event_id % 5 = 4 THEN concat('brief:', CAST(event_id % 9 AS string)) END AS trend_brief_key,
          concat('{"cache_hit":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END,
                 CASE WHEN event_id % 3 = 0 THEN concat(',"rerank_metadata":{},"rerank_latency_ms":', CAST(CAST(floor(value) AS BIGINT) AS string),
                   CASE WHEN event_id % 2 = 0 THEN concat(',"warm_cache_latency_ms":', CAST(event_id % 13 AS string)) ELSE concat(',"cold_cache_latency_ms":', CAST(event_id % 977 AS string)) END) ELSE '' END,
                 CASE WHEN event_id % 4 = 0 THEN concat(',"rewrite_trace":{"original_query":"q', CAST(event_id % 40 AS string), '","rewritten_query":"r', CAST(event_id % 40 AS string),
                   '","rewrite_mode":"', CASE WHEN event_id % 8 = 0 THEN 'hyde' ELSE 'decomposition' END, '","accepted":', CASE WHEN event_id % 8 = 0 THEN 'false' ELSE 'true' END,
                   ',"reject_reason":', CASE WHEN event_id % 8 = 0 THEN '"no_judge"' ELSE 'null' END, '}') ELSE '' END,
                 CASE WHEN event_id % 10 = 1 THEN ',"fallback_reason":"chunk_dense_failed_fell_back_to_article_dense"' ELSE '' END, '}') AS query_input
        FROM events""",
    ),
    "qa_logs": (
        ("events",),
        lambda d: """
        SELECT event_id AS qa_log_id, event_id AS rag_retrieval_run_id, user_id, event_id % 50 AS article_id,
          concat('question ', CAST(event_id % 11 AS string)) AS question, CASE WHEN event_id % 4 = 0 THEN 'zh' ELSE 'en' END AS lang,
          CASE WHEN event_id % 9 <> 0 THEN concat('answer ', CAST(event_id AS string)) END AS response_text,
          CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'boom' END AS error_message,
          CASE event_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 END AS feedback,
          event_id % 3 AS related_count, ts AS asked_at
        FROM events WHERE event_id % 8 <> 7""",
    ),
    "step_events": (
        ("events",),
        lambda d: """
        SELECT event_id, user_id AS run_id, event_type AS step,
          CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skip' ELSE 'error' END AS status,
          CAST(floor(value) AS BIGINT) AS duration_ms, ts AS created_at
        FROM events""",
    ),
    "votes": (
        ("events",),
        lambda d: """
        SELECT event_id, user_id, event_id % 50 AS target_id,
          CASE event_id % 5 WHEN 0 THEN -1 WHEN 4 THEN 0 ELSE 1 END AS feedback, ts
        FROM events""",
    ),
    "generation_results": (
        ("events",),
        lambda d: """
        SELECT event_id, event_type AS mode, concat('answer', CAST(event_id % 2 AS string)) AS answer_model,
          concat('judge', CAST(event_id % 3 AS string)) AS judge_model,
          (event_id % 11) / 10e0 AS faithfulness, (event_id % 7) / 6e0 AS relevancy,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 4) / 3e0 END AS context_precision, (event_id % 3) / 2e0 AS context_recall
        FROM events""",
    ),
    "agentic_traces": (
        ("events",),
        lambda d: """
        SELECT event_id, event_id % 40 AS case_id, event_type AS intent, 1 + event_id % 2 AS retrieval_round,
          CAST(floor(value * 3) AS BIGINT) AS latency_ms
        FROM events""",
    ),
    # briefs: one per (day, cadence), some missing a language
    "briefs": (
        ("events",),
        lambda d: f"""
        SELECT anchor_date, step_days, max(event_id) AS brief_id,
          CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE concat('en ', CAST(max(event_id) AS string)) END AS synthesis_en,
          CASE WHEN max(event_id) % 4 = 0 THEN NULL ELSE concat('zh ', CAST(max(event_id) AS string)) END AS synthesis_zh,
          max(ts) AS generated_at, max(ts) + INTERVAL '6' HOUR AS expires_at
        FROM (SELECT event_id, ts, {d.day('ts')} AS anchor_date, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS step_days FROM events) e
        GROUP BY anchor_date, step_days""",
    ),
    "user_briefs": (
        ("events",),
        lambda d: f"""
        SELECT event_id AS brief_id, user_id, {d.day('ts')} AS anchor_date, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS step_days,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('u ', CAST(event_id AS string)) END AS synthesis_en,
          ts AS generated_at, ts + INTERVAL '6' HOUR AS expires_at
        FROM events""",
    ),
    "digest_sent": (
        ("events",),
        lambda d: f"""
        SELECT target, anchor_date, step_days, max(status) AS status FROM (
          SELECT CASE user_id % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'feishu' WHEN 2 THEN 'discord' ELSE 'notion' END AS target,
            {d.day('ts')} AS anchor_date, CASE WHEN (day(ts) + user_id) % 2 = 0 THEN 1 ELSE 90 END AS step_days,
            CASE WHEN event_id % 8 = 0 THEN 'failed' WHEN event_id % 8 = 1 THEN 'skipped_empty_brief' ELSE 'sent' END AS status
          FROM events) x
        GROUP BY target, anchor_date, step_days""",
    ),
}


class Tables:
    """Lazy access to driver and derived tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    @property
    def spread(self) -> int | None:
        """Parts for heavy work per row where tables are stored in few blocks: the setting ``spark.newsiq.partitions``, if there is one."""
        parts = self.spark.conf.get("spark.newsiq.partitions", None)
        return int(parts) if parts else None

    def spread_out(self, df: DataFrame) -> DataFrame:
        """``df`` in :attr:`spread` parts; as it lies where that is not set, as for tables of many files."""
        return df.repartition(self.spread) if self.spread else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in DERIVED:
                needs, build = DERIVED[name]
                self._cache[name] = self.sql(build(SPARK), *needs)
            else:
                raise AttributeError(name)
        return self._cache[name]

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run SQL over tables of this directory without naming global views."""
        text = text.replace("{", "{{").replace("}", "}}")
        for name in names:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def with_tables(sql: str, names: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the CTEs of the derived tables it uses."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({DERIVED[n][1](DUCK).strip()})" for n in names)
    body = sql.strip()
    head = "WITH"
    for prefix in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(prefix):
            head, body = prefix.strip(), body[len(prefix):]
            return f"{head} {ctes},\n{body}"
    return f"{head} {ctes}\n{body}"
