"""Catalog: evaluation sets, metrics, hard negatives, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.search import CTX_TABLES, K, chunk_sql, fuse_sql, as_rank, knn_sql, lexical_sql, news_articles, queries_of
from newsiq.operators import retrieval as rt
from newsiq.operators import joins
from newsiq.plans import evalset as es
from newsiq.plans import metrics as me
from newsiq.plans import quality, reports

_Q = "SELECT conv_id, turn, text, role FROM conversations"
_RAWQ = """SELECT conv_id * 100 + turn AS article_id, role AS title, CASE turn % 6 WHEN 1 THEN concat('compare ', text) WHEN 2 THEN concat('when ', text) WHEN 3 THEN concat('WHY ', text) WHEN 5 THEN '  ' ELSE concat(' ', text, ' ') END AS question,
  role = 'system' AS stress_test, CASE WHEN conv_id % 3 = 0 THEN 'en' ELSE 'de' END AS lang, CASE WHEN turn % 2 = 0 THEN 'long' END AS cohort, length(text) AS chars FROM conversations"""
_TYPE = "CASE WHEN regexp_matches(lower(question), '比较|对比|versus|vs\\.?|compare') THEN 'comparison' WHEN regexp_matches(lower(question), '时间|日期|开庭|发布|when|date|timeline') THEN 'temporal' WHEN regexp_matches(lower(question), '是否|能否|如何|why|how|impact|影响') THEN 'synthesis' ELSE 'factual' END"


@query(
    "evl_1_normalize_questions",
    f"""SELECT article_id, title, regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS question, CASE WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS lang, CASE WHEN cohort = 'long' THEN 'long' ELSE 'mid' END AS cohort,
      {_TYPE} AS case_type, chars FROM ({_RAWQ}) q WHERE NOT stress_test AND trim(question) <> ''""",
)
def normalize_questions(t):
    return es.normalize_questions(t.sql(_RAWQ, "conversations")).withColumn("chars", F.col("chars").cast("long"))


_SEEDQ = "SELECT case_id * 3 AS article_id, question, lang, 'long' AS cohort, 'temporal' AS case_type FROM cases UNION ALL SELECT primary_article_id, question, 'zh', 'mid', 'factual' FROM cases"


@query(
    "evl_2_seed_cases",
    f"""WITH known AS (SELECT * FROM ({_SEEDQ}) q WHERE article_id IN (SELECT id FROM news)),
      fresh AS (SELECT DISTINCT ON (article_id, question) article_id, question, lang, case_type, cohort FROM known ORDER BY article_id, question, lang, case_type, cohort)
      SELECT coalesce(f.article_id, o.primary_article_id) AS primary_article_id, coalesce(f.question, o.question) AS question, CASE WHEN f.lang IS NOT NULL THEN f.lang ELSE o.lang END AS lang,
        CASE WHEN f.lang IS NOT NULL THEN f.case_type ELSE o.case_type END AS case_type FROM (SELECT * FROM cases WHERE eval_set_id = 0) o FULL JOIN fresh f ON f.article_id = o.primary_article_id AND f.question = o.question""",
    ("cases", "news"),
)
def seed_cases(t):
    out = es.seed_cases(t.cases.where("eval_set_id = 0"), t.sql(_SEEDQ, "cases"), t.news, 0)
    return out.select("primary_article_id", "question", "lang", "case_type")


_EFFECTIVE = """SELECT * FROM gold WHERE review_status = 'approved' UNION ALL SELECT * FROM gold g WHERE review_status = 'pending'
  AND NOT EXISTS (SELECT 1 FROM gold a WHERE a.case_id = g.case_id AND a.review_status = 'approved')"""


@query("evl_3_effective_gold", f"SELECT case_id, article_id, relevance_grade, review_status FROM ({_EFFECTIVE}) g", ("gold",))
def effective_gold(t):
    return es.effective_gold(t.gold).select("case_id", "article_id", "relevance_grade", "review_status")


@query(
    "evl_4_runnable",
    "SELECT case_id, question FROM cases c WHERE EXISTS (SELECT 1 FROM gold g WHERE g.case_id = c.case_id AND g.review_status = 'approved' AND g.relevance_grade >= 2)",
    ("cases", "gold"),
)
def runnable(t):
    return es.runnable(t.cases, es.effective_gold(t.gold, allow_pending=False)).select("case_id", "question")


@query(
    "evl_5_candidates_for_labeling",
    f"""WITH {knn_sql('v', 'article_vectors', 'article_id', K)}, own AS (SELECT case_id AS query_id, primary_article_id AS article_id, 1 AS rank FROM cases), {chunk_sql('h', 20)}, {as_rank('hr', 'h')}, {lexical_sql('x', 20)},
      {fuse_sql('f', [('v', 'vector', 1), ('own', 'primary_article_baseline', 2), ('hr', 'chunk', 1), ('x', 'lexical', 1)], 50, 20)}
      SELECT f.query_id AS case_id, f.article_id, f.rank, f.fusion_sources, CASE WHEN g.evidence_role = 'hard_negative' THEN 0 ELSE coalesce(g.relevance_grade, 0) END AS relevance_grade, coalesce(g.review_status, 'pending') AS review_status
      FROM f LEFT JOIN gold g ON g.case_id = f.query_id AND g.article_id = f.article_id""",
    ("cases", "chunks", "news", "article_vectors", "gold"),
)
def candidates_for_labeling(t):
    q = queries_of(t)
    vec = rt.dense(q, t.article_vectors, K).withColumn("source_key", F.lit("vector"))
    chunk = rt.chunk_dense(q, t.chunks, 20, model="m1").withColumnRenamed("article_rank", "rank").withColumn("source_key", F.lit("chunk"))
    lex = rt.lexical(q, news_articles(t), 20, partitions=t.spread).withColumn("source_key", F.lit("lexical"))
    out = es.candidates_for_labeling([vec, chunk, lex], t.cases, t.gold, K)
    return out.select("case_id", "article_id", "rank", "fusion_sources", "relevance_grade", "review_status")


def chunk_candidates(t, k: int = 25):
    """Raw chunk hits per question, articles repeated, as a replay records them."""
    from newsiq.operators.knn import knn_join

    hits = knn_join(queries_of(t), t.chunks.where("embedding_model = 'm1'"), k, id_col="chunk_id")
    return hits.join(t.chunks.select("chunk_id", "article_id"), "chunk_id").select("query_id", "article_id", "chunk_id", "rank")


CAND = f"""m1 AS (SELECT chunk_id, article_id, embedding FROM chunks WHERE embedding_model = 'm1'), {knn_sql('hit', 'm1', 'chunk_id', 25)},
  cand AS (SELECT h.query_id, c.article_id, h.chunk_id, h.rank FROM hit h JOIN m1 c USING (chunk_id)),
  ded AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM cand GROUP BY 1, 2)"""


@query("evl_6_dedupe_articles", f"WITH {CAND} SELECT query_id, article_id, rank FROM ded", ("cases", "chunks"))
def dedupe_articles(t):
    return me.dedupe_articles(chunk_candidates(t)).select("query_id", "article_id", F.col("rank").cast("long").alias("rank"))


PER_CASE = f"""{CAND}, eff AS ({_EFFECTIVE}),
  ideal AS (SELECT case_id, sum((power(2e0, relevance_grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS ideal FROM (
    SELECT case_id, relevance_grade, row_number() OVER (PARTITION BY case_id ORDER BY relevance_grade DESC, article_id) AS r FROM eff WHERE evidence_role IS DISTINCT FROM 'hard_negative' AND relevance_grade > 0) z GROUP BY 1),
  got AS (SELECT e.case_id, count(DISTINCT e.article_id) FILTER (WHERE e.relevance_grade >= 2) AS n, count(*) FILTER (WHERE e.relevance_grade >= 2 AND d.rank <= 3) AS h3, count(*) FILTER (WHERE e.relevance_grade >= 2 AND d.rank <= 5) AS h5,
    count(*) FILTER (WHERE e.relevance_grade >= 2 AND d.rank <= 10) AS h10, min(d.rank) FILTER (WHERE e.relevance_grade >= 2) AS first,
    sum((power(2e0, e.relevance_grade) - 1) / log2(d.rank + 1)) FILTER (WHERE d.rank <= 10) AS dcg FROM eff e LEFT JOIN ded d ON d.query_id = e.case_id AND d.article_id = e.article_id GROUP BY 1),
  per_case AS (SELECT g.case_id AS query_id, CASE WHEN n > 0 THEN h3 * 1e0 / n ELSE 0 END AS recall_at_3, CASE WHEN n > 0 THEN h5 * 1e0 / n ELSE 0 END AS recall_at_5, CASE WHEN n > 0 THEN h10 * 1e0 / n ELSE 0 END AS recall_at_10,
    coalesce(1e0 / first, 0) AS mrr, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg_at_10, h5 > 0 AS hit_at_5 FROM got g LEFT JOIN ideal i USING (case_id))"""
NAMES = ("recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")


def case_metrics(t):
    gold = es.effective_gold(t.gold).withColumnRenamed("case_id", "query_id")
    return me.per_case(chunk_candidates(t), gold)


@query(
    "evl_7_per_case",
    f"WITH {PER_CASE} SELECT query_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, hit_at_5 FROM per_case",
    ("cases", "chunks", "gold"),
)
def per_case(t):
    return case_metrics(t).select("query_id", *[F.round(n, 6).alias(n) for n in NAMES], "hit_at_5")


@query(
    "evl_8_aggregate",
    f"""WITH {PER_CASE} SELECT count(*) AS total_cases, {', '.join(f'round(avg({n}), 6) AS avg_{n}' for n in NAMES)}, round(avg(CASE WHEN hit_at_5 THEN 1 ELSE 0 END), 6) AS avg_hit_rate_at_5,
      (SELECT CAST(quantile_disc(latency_ms, 0.5) AS DOUBLE) FROM runs) AS latency_p50_ms, (SELECT CAST(quantile_disc(latency_ms, 0.95) AS DOUBLE) FROM runs) AS latency_p95_ms FROM per_case""",
    ("cases", "chunks", "gold", "runs"),
)
def aggregate(t):
    out = me.aggregate(case_metrics(t), latencies=t.runs.select("latency_ms"))
    return out.select("total_cases", *[F.round(f"avg_{n}", 6).alias(f"avg_{n}") for n in NAMES], F.round("avg_hit_rate_at_5", 6).alias("avg_hit_rate_at_5"), "latency_p50_ms", "latency_p95_ms")


@query(
    "evl_8_aggregate_by_strategy",
    f"""SELECT r.strategy, count(*) AS total_cases, {', '.join(f'round(avg({n}), 6) AS avg_{n}' for n in NAMES)}, round(avg(CASE WHEN hit_at_5 THEN 1 ELSE 0 END), 6) AS avg_hit_rate_at_5
      FROM case_results c JOIN eval_runs r USING (run_id) GROUP BY r.strategy""",
    ("case_results", "eval_runs"),
)
def aggregate_by_strategy(t):
    out = me.aggregate(t.case_results.join(t.eval_runs.select("run_id", "strategy"), "run_id"), ["strategy"])
    return out.select("strategy", "total_cases", *[F.round(f"avg_{n}", 6).alias(f"avg_{n}") for n in NAMES], F.round("avg_hit_rate_at_5", 6).alias("avg_hit_rate_at_5"))


@query(
    "evl_9_hard_negatives",
    f"""WITH {CAND}, best AS (SELECT query_id, article_id, min(rank) AS rank FROM cand GROUP BY 1, 2),
      j AS (SELECT g.case_id, g.article_id, g.evidence_role = 'hard_negative' AS hard, g.evidence_role IS DISTINCT FROM 'hard_negative' AND g.relevance_grade >= 2 AS rel, b.rank FROM gold g LEFT JOIN best b ON b.query_id = g.case_id AND b.article_id = g.article_id),
      k AS (SELECT *, min(rank) FILTER (WHERE rel) OVER (PARTITION BY case_id) AS bg FROM j)
      SELECT case_id AS query_id, count(*) FILTER (WHERE hard AND rank < bg) AS hard_negatives_above_gold, min(bg) AS best_gold_rank, min(rank) FILTER (WHERE hard) AS best_hard_negative_rank,
        coalesce(string_agg(article_id, ',' ORDER BY rank) FILTER (WHERE hard AND rank < bg), '') AS hard_negative_article_ids_above_gold FROM k GROUP BY case_id""",
    ("cases", "chunks", "gold"),
)
def hard_negatives(t):
    out = me.hard_negatives(chunk_candidates(t), t.gold.withColumnRenamed("case_id", "query_id"))
    return out.select(
        "query_id", "hard_negatives_above_gold", F.col("best_gold_rank").cast("long").alias("best_gold_rank"),
        F.col("best_hard_negative_rank").cast("long").alias("best_hard_negative_rank"), "hard_negative_article_ids_above_gold",
    )


_T = "coalesce(title_en, title_zh, title, '')"
_WORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower(X), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]+', '', 'g')), lambda w: length(w) >= 3))"


HARD_SQL = f"""WITH art AS MATERIALIZED (SELECT id, source_id, category, published_at, created_at, {_T} AS title, lower({_T} || ' ' || coalesce(summary_en, summary_zh, '')) AS body FROM news),
      ok AS (SELECT DISTINCT case_id FROM gold WHERE review_status = 'approved' AND relevance_grade >= 2),
      ac AS (SELECT c.case_id, c.question, c.primary_article_id, a.source_id, a.category, a.published_at, split_part(a.title, ' ', 1) AS word FROM cases c JOIN ok USING (case_id) JOIN art a ON a.id = c.primary_article_id),
      qt AS MATERIALIZED (SELECT case_id, unnest({_WORDS.replace('X', 'question')}) AS term FROM ac),
      gt AS MATERIALIZED (SELECT DISTINCT case_id, unnest({_WORDS.replace('X', 'a.body')}) AS term FROM gold g JOIN art a ON a.id = g.article_id WHERE g.review_status = 'approved' AND g.relevance_grade >= 2 AND g.evidence_role IS DISTINCT FROM 'hard_negative' AND g.case_id IN (SELECT case_id FROM ac)),
      top AS MATERIALIZED (SELECT DISTINCT r.case_id, c.article_id FROM case_results r JOIN candidates c USING (retrieval_run_id) WHERE c.rank <= 20),
      pool AS MATERIALIZED (SELECT ac.case_id, a.id AS article_id, a.body, a.created_at,
          CASE WHEN a.source_id = ac.source_id THEN 'same_source_wrong_article' WHEN CAST(a.published_at AS DATE) IS DISTINCT FROM CAST(ac.published_at AS DATE) THEN 'same_entity_wrong_time' WHEN a.category = ac.category THEN 'same_topic_wrong_event' ELSE 'semantically_similar_not_answer_supporting' END AS hard_negative_type,
          a.source_id = ac.source_id AS ss, a.category = ac.category AS sc, t.article_id IS NOT NULL AS appeared_in_top_k, abs(epoch(a.published_at) - epoch(ac.published_at)) AS away
        FROM ac JOIN art a ON a.id <> ac.primary_article_id LEFT JOIN top t ON t.case_id = ac.case_id AND t.article_id = a.id
        WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.case_id = ac.case_id AND g.article_id = a.id) AND (a.source_id = ac.source_id OR a.category = ac.category OR contains(lower(a.title), lower(ac.word)) OR t.article_id IS NOT NULL)),
      qo AS (SELECT p.case_id, p.article_id, count(*) AS n FROM pool p JOIN qt ON qt.case_id = p.case_id AND contains(p.body, qt.term) GROUP BY 1, 2),
      go AS (SELECT p.case_id, p.article_id, count(*) AS n FROM pool p JOIN gt ON gt.case_id = p.case_id AND contains(p.body, gt.term) GROUP BY 1, 2),
      sc AS (SELECT p.*, coalesce(qo.n, 0) AS q, coalesce(go.n, 0) AS g FROM pool p LEFT JOIN qo USING (case_id, article_id) LEFT JOIN go USING (case_id, article_id)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY appeared_in_top_k DESC, q DESC, g DESC, ss DESC, sc DESC, floor(away) NULLS LAST, created_at DESC, article_id) AS proposal_rank FROM sc WHERE q >= 1 OR g >= 1 OR appeared_in_top_k)
      SELECT case_id, article_id, hard_negative_type, q AS question_overlap_terms, g AS gold_title_overlap_terms, appeared_in_top_k, proposal_rank FROM rk WHERE proposal_rank <= 10"""


@query("evl_10_hard_negative_mining", HARD_SQL, ("cases", "gold", "news", "case_results", "candidates"))
def hard_negative_mining(t):
    retrieved = t.case_results.select("case_id", "retrieval_run_id").join(t.candidates, "retrieval_run_id").select("case_id", "article_id", "rank")
    out = es.hard_negatives(t.cases, t.gold, t.spread_out(t.news), retrieved)
    return out.select(
        "case_id", "article_id", "hard_negative_type", "question_overlap_terms", "gold_title_overlap_terms", "appeared_in_top_k",
        F.col("proposal_rank").cast("long").alias("proposal_rank"),
    )


@query(
    "win_5_proposal_rank",
    f"SELECT hard_negative_type, proposal_rank, count(*) AS proposals FROM ({HARD_SQL}) h GROUP BY 1, 2",
    ("cases", "gold", "news", "case_results", "candidates"),
)
def proposal_rank(t):
    return hard_negative_mining(t).groupBy("hard_negative_type", "proposal_rank").agg(F.count("*").alias("proposals"))


@query(
    "joi_8_or_of_keys",
    """SELECT DISTINCT c.case_id, n.id AS article_id FROM cases c JOIN news p ON p.id = c.primary_article_id JOIN news n ON (n.source_id = p.source_id AND n.category = p.category) OR n.id IN (SELECT article_id FROM gold g WHERE g.case_id = c.case_id)""",
    ("cases", "news", "gold"),
)
def or_of_keys(t):
    # one equi-join per alternative, then the distinct pairs
    own = t.news.select(F.col("id").alias("primary_article_id"), "source_id", "category")
    base = t.cases.select("case_id", "primary_article_id").join(own, "primary_article_id")
    same = base.join(t.news.select("id", "source_id", "category"), ["source_id", "category"]).select("case_id", F.col("id").alias("article_id"))
    listed = t.cases.select("case_id", "primary_article_id").join(own, "primary_article_id", "left_semi").join(t.gold.select("case_id", "article_id"), "case_id")
    listed = listed.join(t.news.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("case_id", "article_id")
    return same.unionByName(listed).distinct()


@query(
    "joi_8_class_links",
    """WITH p AS (SELECT DISTINCT c.case_id, n.id AS article_id, n.source_id = o.source_id AND n.category = o.category AS inside FROM cases c JOIN news o ON o.id = c.primary_article_id
        JOIN news n ON (n.source_id = o.source_id AND n.category = o.category) OR n.id IN (SELECT article_id FROM gold g WHERE g.case_id = c.case_id))
      SELECT c.case_id, o.source_id, o.category, count(*) FILTER (WHERE inside) AS in_class, count(*) FILTER (WHERE NOT inside) AS outside
      FROM cases c JOIN news o ON o.id = c.primary_article_id LEFT JOIN p ON p.case_id = c.case_id GROUP BY 1, 2, 3""",
    ("cases", "news", "gold"),
)
def class_links(t):
    """The same join as classes: a row per case with its class, the class's size and the listed articles outside it."""
    articles = t.news.select(F.col("id").alias("article_id"), "source_id", "category")
    own = t.cases.select("case_id", F.col("primary_article_id").alias("article_id")).join(articles, "article_id").drop("article_id")
    links, outside = joins.or_of_keys(own, articles, "case_id", "article_id", ["source_id", "category"], t.gold)
    more = outside.groupBy("case_id").agg(F.count("*").alias("outside"))
    out = links.join(more, "case_id", "left")
    return out.select("case_id", "source_id", "category", F.col("members").alias("in_class"), F.coalesce("outside", F.lit(0)).alias("outside"))


_NAME = "[A-Z][A-Za-z0-9$.-]+"
_NAMED = es._NAMED


def taxonomy_sql() -> str:
    dense = f"regexp_matches(question, '({_NAME}.*{_NAME}|{_NAMED}|\\$[0-9])', 'i')"
    time = f"regexp_matches(question, '{es.TIMES}', 'i')"
    return f"""tax AS (SELECT case_id, CASE WHEN source_type IN ('youtube', 'podcast') THEN 'transcript' WHEN source_type IN ('reddit', 'apify_tweet', 'x_api') THEN 'reddit_social' WHEN source_type IN ('official_rss', 'official_html') THEN 'official'
        WHEN n > 1500 THEN 'long_form' WHEN n >= 1 THEN 'short_news' ELSE 'unknown' END AS format_cohort, CASE WHEN n <= 300 THEN 'short_0_300' WHEN n <= 1500 THEN 'medium_301_1500' ELSE 'long_1501_plus' END AS content_length_bucket,
      coalesce(source_type, 'unknown') AS source_type, coalesce(lang, 'zh') AS language,
      CASE WHEN case_type = 'comparison' OR regexp_matches(question, '{es.COMPARES}', 'i') THEN 'comparison' WHEN case_type = 'temporal' OR {time} THEN 'timeline' WHEN regexp_matches(question, '{es.FOLLOWS_UP}', 'i') THEN 'ambiguous_followup'
        WHEN regexp_matches(question, '{es.JOINS}', 'i') THEN 'multi_hop' WHEN regexp_matches(question, '({_NAME}|[0-9]+|{_NAMED})', 'i') THEN 'entity_lookup' ELSE 'single_hop' END AS question_type,
      CASE WHEN {dense} THEN 'high' WHEN regexp_matches(question, '({_NAME}|[0-9]+)', 'i') THEN 'medium' ELSE 'low' END AS entity_density,
      CASE WHEN case_source = 'production_badcase' THEN 'production_badcase' WHEN case_source = 'manual' THEN 'human' ELSE 'synthetic_paraphrase' END AS origin,
      list_filter([CASE WHEN {dense} THEN 'entity_heavy' END, CASE WHEN {time} THEN 'temporal_event' END, CASE WHEN regexp_matches(question, '{es.LEGAL}', 'i') THEN 'legal_policy' END,
        CASE WHEN n > 1500 THEN 'long_context' END, CASE WHEN n <= 300 THEN 'short_sparse' END], lambda x: x IS NOT NULL) AS tags
      FROM (SELECT c.*, s.source_type, length(coalesce(n.article_content, n.summary_en, n.summary_zh, '')) AS n FROM cases c LEFT JOIN news n ON n.id = c.primary_article_id LEFT JOIN sources s USING (source_id)) z)"""


@query(
    "evl_11_taxonomy",
    f"WITH {taxonomy_sql()} SELECT case_id, format_cohort, content_length_bucket, source_type, language, question_type, entity_density, origin, array_to_string(tags, ',') AS tags FROM tax",
    ("cases", "news", "sources"),
)
def taxonomy(t):
    out = es.taxonomy(t.cases, t.news, t.sources)
    return out.withColumn("tags", F.array_join("difficulty_tags", ",")).drop("difficulty_tags")


SLICES = f"""WITH {taxonomy_sql()}, latest AS (SELECT DISTINCT ON (strategy) run_id, strategy FROM eval_runs ORDER BY strategy, created_at DESC, run_id DESC)
  SELECT l.strategy, t.format_cohort, t.source_type, t.question_type, t.entity_density, tag AS difficulty_tag, count(*) AS total_cases, CASE WHEN count(*) < 5 THEN 'directional_n_lt_5' ELSE 'reviewable' END AS slice_status,
    round(avg(r.recall_at_10), 6) AS avg_recall_at_10, round(avg(r.mrr), 6) AS avg_mrr, round(avg(CASE WHEN r.hit_at_5 THEN 1 ELSE 0 END), 6) AS avg_hit_at_5
  FROM latest l JOIN case_results r USING (run_id) JOIN (SELECT *, unnest(tags) AS tag FROM tax) t USING (case_id) GROUP BY ALL"""


def _slices(t):
    out = reports.taxonomy_slices(t.eval_runs, t.case_results, es.taxonomy(t.cases, t.news, t.sources))
    return out.select(
        "strategy", "format_cohort", "source_type", "question_type", "entity_density", "difficulty_tag", "total_cases", "slice_status",
        *[F.round(c, 6).alias(c) for c in ("avg_recall_at_10", "avg_mrr", "avg_hit_at_5")],
    )


@query("evl_12_taxonomy_slices", SLICES, ("cases", "news", "sources", "eval_runs", "case_results"))
def taxonomy_slices(t):
    return _slices(t)


@query("agg_14_json_paths_and_tags", SLICES, ("cases", "news", "sources", "eval_runs", "case_results"))
def json_paths_and_tags(t):
    return _slices(t)


@query(
    "evl_13_metric_bounds",
    """SELECT r.strategy, max(c.recall_at_10) AS max_recall_at_10, max(c.ndcg_at_10) AS max_ndcg_at_10 FROM (SELECT run_id, recall_at_10 * CASE WHEN run_id % 10 = 3 THEN 1.5 ELSE 1 END AS recall_at_10, ndcg_at_10 FROM case_results) c JOIN eval_runs r USING (run_id)
      GROUP BY 1 HAVING max(c.recall_at_10) > 1 OR max(c.ndcg_at_10) > 1""",
    ("case_results", "eval_runs"),
)
def metric_bounds(t):
    bad = t.case_results.withColumn("recall_at_10", F.expr("recall_at_10 * CASE WHEN run_id % 10 = 3 THEN 1.5D ELSE 1D END"))
    return quality.metric_bounds(bad, t.eval_runs)


@query(
    "evl_14_parse_notes",
    """SELECT run_id, run_id % 3 = 1 AS valid_for_strategy_selection, CASE WHEN run_id % 3 <> 1 THEN 'legacy_or_nonconforming_notes' END AS invalid_reason, CASE WHEN run_id % 3 = 1 THEN CAST(run_id AS VARCHAR) END AS corpus_health_run_id FROM eval_runs""",
    ("eval_runs",),
)
def parse_notes(t):
    return quality.parse_notes(t.eval_runs).select("run_id", "valid_for_strategy_selection", "invalid_reason", "corpus_health_run_id")


@query(
    "evl_15_generation_scores",
    "SELECT mode, answer_model, judge_model, count(*) AS rows, round(avg(faithfulness), 6) AS avg_faithfulness, round(avg(relevancy), 6) AS avg_relevancy, round(avg(context_precision), 6) AS avg_context_precision, round(avg(context_recall), 6) AS avg_context_recall FROM generation_results GROUP BY 1, 2, 3",
    ("generation_results",),
)
def generation_scores(t):
    out = reports.generation_scores(t.generation_results)
    return out.select("mode", "answer_model", "judge_model", "rows", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("avg_")])


@query(
    "evl_16_agentic_slices",
    """SELECT intent, count(DISTINCT case_id) AS slice_n, max(retrieval_round) AS max_retrieval_round, count(*) FILTER (WHERE retrieval_round > 2) AS loop_safety_violations, round(avg(latency_ms), 6) AS avg_latency_ms,
      CASE WHEN count(DISTINCT case_id) >= 5 THEN 'eligible_for_pass_fail' ELSE 'directional_only' END AS interpretation FROM agentic_traces GROUP BY intent""",
    ("agentic_traces",),
)
def agentic_slices(t):
    return reports.agentic_slices(t.agentic_traces).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))
