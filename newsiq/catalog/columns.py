"""Catalog: column logic over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.sqltext import CANON, NORM, SIM, SQUEEZE, TRGM
from newsiq.functions import social as so
from newsiq.functions import text as tx
from newsiq.operators import chunks as ch
from newsiq.plans import analysis as an
from newsiq.plans import enrich, feed, quality, queue, reports

# RE2 has no look-around: the word boundary is spelled as neighbours
_AI = f"(^|[^\\p{{L}}\\p{{N}}_])({tx.AI_WORDS})($|[^\\p{{L}}\\p{{N}}_])"
AI_SQL = (
    f"(regexp_matches(TXT, '{_AI}', 'i') OR regexp_matches(TXT, '{tx.AI_PHRASES}', 'i') OR regexp_matches(TXT, '{'|'.join(tx.AI_ZH)}'))"
)


def ai_sql(x: str) -> str:
    return AI_SQL.replace("TXT", x)


@query("prj_1_is_ai_relevant", f"SELECT doc_id, {ai_sql('text')} AS relevant FROM documents")
def is_ai_relevant(t):
    return t.spread_out(t.documents).select("doc_id", tx.is_ai_relevant("text").alias("relevant"))


@query("udx_1_sql_function", f"SELECT lang, count(*) AS docs, count(*) FILTER (WHERE {ai_sql('text')}) AS relevant FROM documents GROUP BY lang")
def sql_function(t):
    tx.register(t.spark)
    return t.sql("SELECT lang, count(*) AS docs, count_if(is_ai_relevant(text)) AS relevant FROM documents GROUP BY lang", "documents")


@query(
    "prj_2_bilingual",
    """SELECT id, coalesce(title_en, title) AS title_en, coalesce(title_zh, title) AS title_zh, coalesce(summary_en, summary) AS summary_en, coalesce(summary_zh, summary) AS summary_zh FROM news""",
    ("news",),
)
def bilingual(t):
    return enrich.bilingual(t.news).select("id", "title_en", "title_zh", "summary_en", "summary_zh")


@query(
    "prj_3_in_window",
    """SELECT id FROM news WHERE (published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-17')
      OR (published_at IS NULL AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-17')""",
    ("news",),
)
def in_window(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return t.news.where(tx.in_window("published_at", "created_at", day("2024-01-10"), day("2024-01-17"))).select("id")


@query("prj_4_canonical_url", f"SELECT id, {CANON('url')} AS url FROM items UNION ALL SELECT -page_id, {CANON('url')} FROM pages", ("items",))
def canonical_url(t):
    rows = t.items.select("id", "url").unionByName(t.pages.select((-F.col("page_id")).alias("id"), "url"))
    return rows.select("id", tx.canonical_url("url").alias("url"))


@query("prj_5_normalize_text", f"SELECT doc_id, sha256(n) AS digest, length(n) AS chars FROM (SELECT doc_id, {NORM('text')} AS n FROM documents) x")
def normalize_text(t):
    out = t.documents.select("doc_id", tx.normalize_text("text").alias("n"))
    return out.select("doc_id", F.sha2("n", 256).alias("digest"), F.length("n").cast("long").alias("chars"))


@query(
    "prj_6_fingerprint",
    f"""SELECT id, sha256(concat_ws(chr(10), {CANON('url')}, {NORM('title')}, substr({NORM('body')}, 1, 4000), strftime(published_at, '%Y-%m-%d'), trust_tier)) AS fp FROM items""",
    ("items",),
)
def fingerprint(t):
    from newsiq.operators.dedup import fingerprint as fp

    return t.items.select("id", fp("url", "title", "body", "published_at", "trust_tier").alias("fp"))


_BOIL = " + ".join(f"len(regexp_extract_all(s, '\\b{p}\\b', 0, 'i'))" for p in tx.BOILERPLATE)
_TECH = " + ".join(f"CAST(regexp_matches(s, '\\b({p})\\b', 'i') AS BIGINT)" for p in tx.TECHNICAL)


@query(
    "prj_7_usable_score",
    f"""SELECT id, length(s) AS usable_chars, {_TECH} AS technical_hits, {_BOIL} AS boilerplate_hits,
        CAST(length(s) + CASE WHEN trim(title) <> '' THEN 250 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 150 ELSE 0 END + 80 * ({_TECH}) - 120 * ({_BOIL})
          - CASE WHEN length(n) > 0 THEN greatest(0, floor((1e0 - length(n) * 1e0 / greatest(length(s), 1)) * 100 + 0.5e0)) ELSE 0 END AS BIGINT) AS score
      FROM (SELECT id, title, published_at, {SQUEEZE('body')} AS s, {NORM('body')} AS n FROM
        (SELECT id, title, published_at, concat(body, CASE WHEN id % 3 = 0 THEN ' Read more. Model methods and a benchmark.' ELSE '' END) AS body FROM items) b) x""",
    ("items",),
)
def usable_score(t):
    extra = F.when(F.expr("id % 3 = 0"), " Read more. Model methods and a benchmark.").otherwise("")
    rows = t.spread_out(t.items).withColumn("body", F.concat("body", extra))
    return rows.select("id", tx.usable_content("title", "body", "published_at").alias("u")).select("id", "u.*")


_HINT = "CASE " + " ".join(f"WHEN regexp_matches(h, '\\b({w})\\b') THEN '{k}'" for k, w in tx.CONTENT_TYPES) + " ELSE 'unknown' END"
_WORDS = "CASE id % 8 WHEN 0 THEN 'alignment' WHEN 1 THEN 'latency' WHEN 2 THEN 'paper' WHEN 3 THEN 'report' WHEN 4 THEN 'pricing' WHEN 5 THEN 'introducing' WHEN 6 THEN 'reported' ELSE '' END"


@query(
    "prj_8_content_type_hint",
    f"SELECT id, {_HINT} AS hint FROM (SELECT id, {NORM(f'concat(url, chr(32), title, chr(32), {_WORDS}, chr(32), body)')} AS h FROM items) x",
    ("items",),
)
def content_type_hint(t):
    words = F.expr(_WORDS)
    return t.items.select("id", tx.content_type_hint("url", F.concat("title", F.lit(" "), words), "body").alias("hint"))


@query(
    "prj_9_infer_org",
    """SELECT source_id, CASE WHEN lower(name || ' ' || rss_url) LIKE '%anthropic%' THEN 'anthropic' WHEN lower(name || ' ' || rss_url) LIKE '%deepmind%' THEN 'google_deepmind'
      WHEN lower(name || ' ' || rss_url) LIKE '%openai%' THEN 'openai' ELSE 'unknown' END AS org FROM sources""",
    ("sources",),
)
def infer_org(t):
    return t.sources.select("source_id", tx.infer_org("name", "rss_url").alias("org"))


@query(
    "prj_10_social_key",
    """SELECT source_id, CASE WHEN rss_url LIKE '%youtube.com/@%' THEN 'youtube:@' || lower(regexp_extract(rss_url, '@([^/]+)$', 1)) ELSE regexp_replace(rss_url, '/+$', '') END AS social_key FROM sources""",
    ("sources",),
)
def social_key(t):
    return t.sources.select("source_id", so.social_key("rss_url").alias("social_key"))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(html, '<style[^>]*>.*?</style>', '', 'gis'), '<script[^>]*>.*?</script>', '', 'gis'), '<[^>]+>', ' ', 'g')"
_STRIP = f"replace(replace(replace(replace({_STRIP}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' ')"
_STRIP = SQUEEZE(f"regexp_replace({_STRIP}, '&#\\d+;', '', 'g')")


@query("prj_11_strip_html", f"SELECT page_id, {_STRIP} AS plain FROM pages")
def strip_html(t):
    return t.pages.select("page_id", tx.strip_html("html").alias("plain"))


@query(
    "prj_12_is_walled",
    """SELECT id, lower(substr(body, 1, 300)) LIKE '%subscribe%' AND lower(substr(body, 1, 300)) LIKE '%sign in%' OR body LIKE '%去验证%' AS walled
      FROM (SELECT id, concat(CASE id % 5 WHEN 0 THEN 'Subscribe or Sign In. ' WHEN 1 THEN 'sign in ' ELSE '' END, body, CASE WHEN id % 7 = 0 THEN ' 去验证' ELSE '' END) AS body FROM items) x""",
    ("items",),
)
def is_walled(t):
    body = F.expr("concat(CASE id % 5 WHEN 0 THEN 'Subscribe or Sign In. ' WHEN 1 THEN 'sign in ' ELSE '' END, body, CASE WHEN id % 7 = 0 THEN ' 去验证' ELSE '' END)")
    return t.items.select("id", tx.is_walled(body).alias("walled"))


@query(
    "prj_13_engagement",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) WHEN 3 THEN '0' END AS likes, CASE event_id % 5 WHEN 0 THEN '0' END AS retweets,
      CASE event_id % 5 WHEN 1 THEN CAST(event_id AS VARCHAR) END AS stars, CASE event_id % 5 WHEN 2 THEN CAST(event_id AS VARCHAR) END AS score, CASE event_id % 5 WHEN 3 THEN 'show' WHEN 4 THEN 'show' END AS show_name FROM events""",
)
def engagement(t):
    rows = t.events.selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN 'https://x.com/a/status/1' WHEN 1 THEN 'https://github.com/a/b' WHEN 2 THEN 'https://www.reddit.com/r/x' ELSE 'https://v' END AS url",
        "CASE event_id % 5 WHEN 3 THEN 'youtube' ELSE 'rss' END AS source_type",
        """CASE event_id % 5 WHEN 0 THEN map('likes', CAST(event_id % 100 AS STRING)) WHEN 1 THEN map('stars', CAST(event_id AS STRING))
           WHEN 2 THEN map('score', CAST(event_id AS STRING)) ELSE map('show_name', 'show') END AS metadata""",
    )
    out = rows.withColumn("e", enrich.engagement("url", "source_type", "metadata"))
    return out.select("event_id", *[F.element_at("e", k).alias(k) for k in ("likes", "retweets", "stars", "score", "show_name")])


@query("prj_14_engagement_score", "SELECT id, coalesce(likes, score, 0) AS engagement FROM news", ("news",))
def engagement_score(t):
    return t.news.select("id", enrich.engagement_score("likes", "score").cast("long").alias("engagement"))


@query(
    "prj_15_metadata",
    "SELECT n.id, CASE WHEN s.source_type IN ('aihot', 'official_rss') THEN n.title END AS title_meta FROM news n JOIN sources s USING (source_id)",
    ("news", "sources"),
)
def metadata(t):
    rows = t.news.join(t.sources, "source_id").select("id", enrich.metadata("source_type", F.create_map(F.lit("title"), "title")).alias("m"))
    return rows.select("id", F.element_at("m", "title").alias("title_meta"))


_LABEL = "CASE id % 4 WHEN 0 THEN category WHEN 1 THEN 'sports' WHEN 2 THEN NULL ELSE 'industry' END"


@query(
    "prj_16_category",
    f"""SELECT x.id, CASE WHEN label IN ('industry', 'technical_frontier', 'career_community') THEN label ELSE s.category END AS category
      FROM (SELECT id, source_id, {_LABEL} AS label FROM news) x LEFT JOIN sources s USING (source_id)""",
    ("news", "sources"),
)
def category(t):
    rows, _ = enrich.category(t.news.select("id", "source_id", F.expr(_LABEL).alias("llm_category")), t.sources)
    return rows.select("id", "category")


@query(
    "prj_16_category_mismatch",
    f"""SELECT x.id, concat('llm_output=', coalesce(label, 'null'), ' fallback=', s.category) AS error_text FROM (SELECT id, source_id, {_LABEL} AS label FROM news) x
      LEFT JOIN sources s USING (source_id) WHERE NOT coalesce(label IN ('industry', 'technical_frontier', 'career_community'), false)""",
    ("news", "sources"),
)
def category_mismatch(t):
    _, bad = enrich.category(t.news.select("id", "source_id", F.expr(_LABEL).alias("llm_category")), t.sources)
    return bad.select("id", "error_text")


_ROUTE = """SELECT id, CASE WHEN id % 6 = 0 THEN 'https://x.com/u/status/1' ELSE url END AS url, CASE WHEN id % 11 = 0 THEN ' <p> </p> ' ELSE title END AS raw_content,
  CASE id % 7 WHEN 0 THEN 'INSUFFICIENT_CONTENT' WHEN 1 THEN 'NOT_AI_RELEVANT' END AS sentinel, CASE WHEN id % 5 = 0 THEN '' ELSE summary END AS summary_en, summary AS summary_zh FROM news"""


@query(
    "prj_17_route",
    f"""SELECT id, status, CASE status WHEN 'done' THEN NULL ELSE err END AS last_error FROM (SELECT id, err, CASE WHEN err IS NULL THEN 'done' WHEN err LIKE 'Validation%' THEN 'retry' ELSE 'error' END AS status FROM (
      SELECT id, CASE WHEN id % 11 = 0 THEN 'empty raw_content' WHEN id % 6 = 0 AND NOT {ai_sql('raw_content')} THEN 'NOT_AI_RELEVANT' WHEN sentinel IS NOT NULL THEN sentinel
        WHEN summary_en = '' THEN 'Validation Error: Empty summary field' END AS err FROM ({_ROUTE}) r) y) z""",
    ("news",),
)
def route(t):
    return enrich.route(t.sql(_ROUTE, "news")).select("id", "status", "last_error")


@query(
    "prj_18_after_failure",
    "SELECT id, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 >= 3 THEN 'error' ELSE 'pending' END AS status, 'boom' AS last_error FROM raw",
    ("raw",),
)
def after_failure(t):
    return queue.after_failure(t.raw, "boom").select("id", "retry_count", "status", "last_error")


@query(
    "prj_19_analysis_input",
    f"""SELECT id, length(s) AS input_chars, length(s) > 5000 AS truncated, sha256(substr(s, 1, 5000)) AS digest, length(trim(coalesce(article_content, ''))) > 500 AS eligible
      FROM (SELECT id, article_content, {SQUEEZE("coalesce(article_content, '')")} AS s FROM news) x""",
    ("news",),
)
def analysis_input(t):
    rows = t.news.select("id", an.prepare("article_content", 5000).alias("p"), an.eligible("article_content").alias("eligible"))
    return rows.select("id", "p.input_chars", "p.truncated", F.sha2("p.content", 256).alias("digest"), "eligible")


@query(
    "prj_20_embedding_input",
    f"""SELECT id, sha256(substr(coalesce(article_content, summary, ''), 1, 2000)) AS plain, sha256(substr({SQUEEZE("regexp_replace(coalesce(article_content, ''), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')")}, 1, 2500)) AS sanitized FROM news""",
    ("news",),
)
def embedding_input(t):
    return t.news.select(
        "id",
        F.sha2(ch.embedding_input("article_content", "summary"), 256).alias("plain"),
        F.sha2(tx.sanitize_for_embedding("article_content"), 256).alias("sanitized"),
    )


@query(
    "prj_21_annotate",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[㐀-鿿]') THEN 'zh' ELSE 'en' END AS language, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate, sha256(text) AS chunk_hash FROM documents",
)
def annotate(t):
    return ch.annotate(t.documents, "text").select("doc_id", "language", "token_estimate", "chunk_hash")


_BAD_GOLD = "SELECT case_id, article_id, CASE WHEN article_id % 7 = 6 THEN 5 ELSE relevance_grade END AS relevance_grade, CASE WHEN case_id % 9 = 8 THEN 'maybe' ELSE review_status END AS review_status, CASE WHEN article_id % 5 = 0 THEN 'hard_negative' ELSE evidence_role END AS evidence_role FROM gold"


@query(
    "prj_22_validate_domain",
    f"""SELECT case_id, article_id, concat_ws(',', CASE WHEN NOT (relevance_grade BETWEEN 0 AND 3) THEN 'relevance_grade_range' END,
        CASE WHEN review_status NOT IN ('pending', 'approved', 'rejected') THEN 'review_status_domain' END,
        CASE WHEN evidence_role = 'hard_negative' AND relevance_grade <> 0 THEN 'hard_negative_zero_grade' END) AS broken
      FROM ({_BAD_GOLD}) g WHERE NOT (relevance_grade BETWEEN 0 AND 3) OR review_status NOT IN ('pending', 'approved', 'rejected') OR (evidence_role = 'hard_negative' AND relevance_grade <> 0)""",
    ("gold",),
)
def validate_domain(t):
    _, bad = quality.validate(t.sql(_BAD_GOLD, "gold"), quality.GOLD_RULES)
    return bad.select("case_id", "article_id", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "prj_25_bullets",
    """SELECT id, array_to_string(list_filter(string_split(s, chr(10)), lambda l: starts_with(trim(l), '•') OR starts_with(trim(l), '-')), ' | ') AS bullets
      FROM (SELECT id, replace(replace(summary, '. ', chr(10) || '- '), ', ', chr(10) || ' • ') AS s FROM news) x""",
    ("news",),
)
def bullets(t):
    s = F.replace(F.replace("summary", F.lit(". "), F.lit("\n- ")), F.lit(", "), F.lit("\n • "))
    return t.news.select("id", tx.bullets(s).alias("bullets"))


@query(
    "prj_26_access",
    """SELECT n.id, coalesce('own ' || CAST(o.article_id AS VARCHAR), n.questions) AS questions,
      CASE WHEN o.article_id IS NOT NULL THEN 'user_override' WHEN n.questions IS NOT NULL THEN 'auto_default' END AS questions_source, a.status AS analysis_status
      FROM news n LEFT JOIN (SELECT id AS article_id FROM news WHERE published_at IS NULL) o ON o.article_id = n.id LEFT JOIN analysis a ON a.article_id = n.id""",
    ("news", "analysis"),
)
def access(t):
    own = t.news.where("published_at IS NULL").select(F.col("id").alias("article_id"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("questions"))
    rows = t.news.select("id", "questions").join(t.analysis.select(F.col("article_id").alias("id"), F.col("status").alias("analysis_status")), "id", "left")
    return feed.apply_access(rows, True, own, ["analysis_status"])


@query(
    "prj_28_flatten_query_input",
    """SELECT run_id, CAST(json_extract_string(query_input, '$.cache_hit') AS BOOLEAN) AS cache_hit, CAST(json_extract_string(query_input, '$.rerank_latency_ms') AS BIGINT) AS rerank_latency_ms,
      json_exists(query_input, '$.rerank_metadata') AS has_rerank, json_extract_string(query_input, '$.rewrite_trace.rewrite_mode') AS rewrite_mode,
      json_extract_string(query_input, '$.fallback_reason') AS fallback_reason FROM runs""",
    ("runs",),
)
def flatten_query_input(t):
    out = reports.flatten_query_input(t.runs)
    return out.select("run_id", "cache_hit", "rerank_latency_ms", "has_rerank", "rewrite_mode", "fallback_reason")


@query(
    "prj_trigram_similarity",
    f"SELECT id, round({SIM('a', 'b')}, 6) AS similarity FROM (SELECT id, {TRGM('title')} AS a, {TRGM('summary')} AS b FROM news) x",
    ("news",),
)
def trigram_similarity(t):
    return t.news.select("id", F.round(tx.trigram_similarity("title", "summary"), 6).alias("similarity"))
