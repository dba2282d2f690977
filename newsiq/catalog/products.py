"""Catalog: feed, briefs, caches, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.search import knn_sql
from newsiq.catalog.tables import AS_OF
from newsiq.plans import brief, digest, feed, qa
from newsiq.sources import feeds

_WIN = """((published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-20') OR (published_at IS NULL AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20'))"""
_PAGE = f"""page AS (SELECT * FROM news WHERE {_WIN} AND category = 'industry' ORDER BY created_at DESC, id DESC LIMIT 20)"""


@query(
    "prd_1_grouped_feed",
    f"""WITH {_PAGE} SELECT p.id, coalesce(p.title_en, p.title) AS title_en, coalesce(p.title_zh, p.title) AS title_zh, s.source_type, s.name AS source_name, CASE WHEN s.source_type = 'apify_tweet' THEN s.handle END AS thread_group,
      CASE WHEN s.source_type = 'apify_tweet' THEN s.bio END AS thread_bio, p.url, p.created_at, CAST(NULL AS VARCHAR) AS questions, CAST(NULL AS VARCHAR) AS questions_source, CAST(NULL AS VARCHAR) AS deep_analysis_status,
      (SELECT id FROM page ORDER BY created_at, id LIMIT 1) AS next_cursor FROM page p JOIN sources s USING (source_id)""",
    ("news", "sources"),
)
def grouped_feed(t):
    out = feed.grouped(t.news, t.sources, "2024-01-10", "2024-01-20", category="industry", limit=20, analysis=t.analysis)
    return out.select("id", "title_en", "title_zh", "source_type", "source_name", "thread_group", "thread_bio", "url", "created_at", "questions", "questions_source", "deep_analysis_status", "next_cursor")


@query(
    "prd_1_grouped_feed_premium",
    f"""WITH {_PAGE} SELECT p.id, coalesce('own ' || CAST(o.id AS VARCHAR), p.questions) AS questions, CASE WHEN o.id IS NOT NULL THEN 'user_override' WHEN p.questions IS NOT NULL THEN 'auto_default' END AS questions_source, a.analysis_id AS deep_analysis_id, a.status AS deep_analysis_status
      FROM page p JOIN sources s USING (source_id) LEFT JOIN analysis a ON a.article_id = p.id LEFT JOIN (SELECT id FROM news WHERE published_at IS NULL) o ON o.id = p.id""",
    ("news", "sources", "analysis"),
)
def grouped_feed_premium(t):
    own = t.news.where("published_at IS NULL").select(F.col("id").alias("article_id"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("questions"))
    out = feed.grouped(t.news, t.sources, "2024-01-10", "2024-01-20", category="industry", limit=20, can_view=True, overrides=own, analysis=t.analysis)
    return out.select("id", "questions", "questions_source", "deep_analysis_id", "deep_analysis_status")


# the feed cut into pages of two hundred ids
@query(
    "prd_2_threads",
    """SELECT page, position, handle, posts, total_likes, ids FROM (SELECT page, min(pos) AS position, max(handle) AS handle, count(*) AS posts, CAST(sum(coalesce(likes, 0)) AS BIGINT) AS total_likes, string_agg(id, ',' ORDER BY coalesce(likes, 0) DESC, pos) AS ids FROM (
      SELECT n.id, n.id AS pos, CAST(floor(n.id / 200) AS BIGINT) AS page, n.likes, CASE WHEN s.source_type = 'apify_tweet' THEN s.handle END AS handle FROM news n JOIN sources s USING (source_id)) x GROUP BY page, coalesce('h:' || handle, 'i:' || CAST(id AS VARCHAR))) y""",
    ("news", "sources"),
)
def threads(t):
    src = t.sources.select("source_id", F.when(F.col("source_type") == "apify_tweet", F.col("handle")).alias("thread_group"))
    rows = t.news.join(src, "source_id").select(F.col("id").alias("pos"), "id", "url", F.floor(F.col("id") / 200).cast("long").alias("page"), "thread_group", "likes")
    return feed.threads(rows, ["page"])


@query(
    "prd_3_new_since",
    f"SELECT count(*) AS new_items FROM news WHERE created_at > TIMESTAMP '2024-01-12 06:00:00' AND category = 'industry' AND {_WIN}",
    ("news",),
)
def new_since(t):
    return feed.new_since(t.news, "2024-01-12 06:00:00", "industry", "2024-01-10", "2024-01-20")


# one window per (day, cadence) that appears in the briefs
_ART = "SELECT id, title, url, summary_en, summary_zh, coalesce(likes, score, 0) AS eng, coalesce(published_at, created_at) AS at FROM news"
SELECTED = f"""art AS MATERIALIZED ({_ART}), wins AS (SELECT DISTINCT anchor_date, step_days FROM briefs),
  sel AS MATERIALIZED (SELECT * FROM (SELECT w.anchor_date, w.step_days, a.id, a.eng, a.at, row_number() OVER (PARTITION BY w.anchor_date, w.step_days ORDER BY a.eng DESC, a.at DESC, a.id) AS rank
    FROM wins w JOIN art a ON CAST(a.at AS DATE) > w.anchor_date - CAST(w.step_days AS INTEGER) AND CAST(a.at AS DATE) <= w.anchor_date) z WHERE rank <= 12)"""


def selected(t):
    return brief.select(t.news, t.briefs.select("anchor_date", "step_days"))


@query("prd_4_brief_selection", f"WITH {SELECTED} SELECT anchor_date, step_days, id, rank, CAST(eng AS BIGINT) AS engagement FROM sel", ("news", "briefs"))
def brief_selection(t):
    return selected(t).select("anchor_date", F.col("step_days").cast("int").alias("step_days"), "id", F.col("rank").cast("long").alias("rank"), "engagement")


HISTORY = f"""{SELECTED}, cases AS (SELECT date_diff('day', DATE '1970-01-01', s.anchor_date) * 1000 + s.step_days AS case_id, s.anchor_date, s.step_days, v.embedding AS query_embedding FROM sel s JOIN vec v ON v.article_id = s.id WHERE s.rank = 1),
  {knn_sql('near', 'vec', 'article_id', 15)},
  hist AS (SELECT c.anchor_date, c.step_days, h.article_id, h.rank, EXISTS (SELECT 1 FROM sel s WHERE s.anchor_date = c.anchor_date AND s.step_days = c.step_days AND s.id = h.article_id) AS selected,
     CAST(a.at AS DATE) > c.anchor_date - CAST(c.step_days AS INTEGER) AND CAST(a.at AS DATE) <= c.anchor_date AS in_window FROM near h JOIN cases c ON c.case_id = h.query_id JOIN art a ON a.id = h.article_id),
  marked AS (SELECT *, coalesce(sum(CASE WHEN NOT selected AND NOT in_window THEN 1 ELSE 0 END) OVER (PARTITION BY anchor_date, step_days ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM hist)"""
# an article has the vector of its id; articles beyond the embeddings have none
VEC = "vec AS (SELECT n.id AS article_id, e.embedding FROM news n JOIN embeddings e ON e.vec_id = n.id)"


def vectors(t):
    return t.news.select(F.col("id").alias("article_id")).join(t.embeddings, F.col("article_id") == F.col("vec_id")).select("article_id", "embedding")


@query(
    "prd_5_brief_history",
    f"WITH {VEC}, {HISTORY} SELECT anchor_date, step_days, article_id, rank, CASE WHEN taken >= 8 THEN 'not_evaluated_after_context_cap' WHEN selected THEN 'current_window_selected' WHEN in_window THEN 'current_window_article' END AS drop_reason FROM marked",
    ("news", "briefs"),
)
def brief_history(t):
    out = brief.history(selected(t), vectors(t), t.news)
    return out.select("anchor_date", F.col("step_days").cast("int").alias("step_days"), "article_id", F.col("rank").cast("long").alias("rank"), "drop_reason")


@query(
    "prd_6_brief_sources",
    f"""WITH {VEC}, {HISTORY}, u AS (SELECT anchor_date, step_days, rank AS n, id, false AS is_historical FROM sel UNION ALL SELECT anchor_date, step_days, rank, article_id, true FROM marked WHERE taken < 8 AND NOT selected AND NOT in_window)
      SELECT u.anchor_date, u.step_days, row_number() OVER (PARTITION BY u.anchor_date, u.step_days ORDER BY is_historical, n) AS index, u.id, u.is_historical, CASE WHEN NOT is_historical THEN a.url END AS url FROM u JOIN art a ON a.id = u.id""",
    ("news", "briefs"),
)
def brief_sources(t):
    sel = selected(t)
    out = brief.sources(sel, brief.history(sel, vectors(t), t.news), t.news)
    return out.select("anchor_date", F.col("step_days").cast("int").alias("step_days"), "index", "id", "is_historical", "url")


@query(
    "prd_6_brief_blocks",
    f"""WITH {SELECTED} SELECT s.anchor_date, s.step_days, string_agg('[' || s.rank || '] ' || a.title || ' | ' || strftime(a.at, '%b %-d') || ' | ' ||
        array_to_string(list_filter(string_split(coalesce(a.summary_en, ''), chr(10)), lambda l: starts_with(trim(l), '•') OR starts_with(trim(l), '-')), ' | '), chr(10) ORDER BY s.rank) AS block
      FROM sel s JOIN art a USING (id) GROUP BY 1, 2""",
    ("news", "briefs"),
)
def brief_blocks(t):
    sel = selected(t)
    none = t.news.select(F.lit(None).cast("date").alias("anchor_date"), F.lit(0).alias("step_days"), F.lit(0).alias("rank"), F.col("id").alias("article_id"), F.lit(False).alias("injected")).limit(0)
    return brief.blocks(brief.sources(sel, none, t.news), "en").withColumn("step_days", F.col("step_days").cast("int"))


_REQ = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS anchor_date, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS step_days FROM events"


@query(
    "prd_7_resolve_cache",
    f"""WITH req AS ({_REQ}), own AS (SELECT DISTINCT ON (user_id, anchor_date, step_days) * FROM user_briefs WHERE expires_at > TIMESTAMP '2024-01-10 12:00:00' ORDER BY user_id, anchor_date, step_days, generated_at DESC, brief_id DESC),
      sh AS (SELECT DISTINCT ON (anchor_date, step_days) * FROM briefs WHERE expires_at > TIMESTAMP '2024-01-10 12:00:00' ORDER BY anchor_date, step_days, generated_at DESC, brief_id DESC)
      SELECT r.user_id, r.anchor_date, r.step_days, CASE WHEN coalesce(o.synthesis_en, '') <> '' THEN 'user' WHEN coalesce(s.synthesis_en, '') <> '' THEN 'shared' ELSE 'miss' END AS cache,
        CASE WHEN coalesce(o.synthesis_en, '') <> '' THEN o.synthesis_en WHEN coalesce(s.synthesis_en, '') <> '' THEN s.synthesis_en END AS synthesis, CASE WHEN coalesce(o.synthesis_en, '') <> '' THEN o.brief_id WHEN coalesce(s.synthesis_en, '') <> '' THEN s.brief_id END AS brief_id
      FROM req r LEFT JOIN own o ON o.user_id = r.user_id AND o.anchor_date = r.anchor_date AND o.step_days = r.step_days LEFT JOIN sh s ON s.anchor_date = r.anchor_date AND s.step_days = r.step_days""",
    ("user_briefs", "briefs"),
)
def resolve_cache(t):
    return brief.resolve_cache(t.sql(_REQ, "events"), t.user_briefs, t.briefs, "2024-01-10 12:00:00")


@query(
    "prd_7_newest_daily",
    "SELECT brief_id, anchor_date, synthesis_en, synthesis_zh FROM briefs WHERE step_days = 1 ORDER BY generated_at DESC, brief_id DESC LIMIT 1",
    ("briefs",),
)
def newest_daily(t):
    return brief.newest_daily(t.briefs).select("brief_id", "anchor_date", "synthesis_en", "synthesis_zh")


_KEY = "user_id, article_id, question, lang"


@query(
    "prd_8_cache_hits",
    f"""WITH n AS (SELECT DISTINCT ON ({_KEY}) * FROM qa_logs ORDER BY {_KEY}, asked_at DESC, qa_log_id DESC)
      SELECT r.event_id, n.qa_log_id, n.response_text FROM (SELECT event_id, user_id, event_id % 50 AS article_id, concat('question ', CAST(event_id % 11 AS VARCHAR)) AS question, CASE WHEN event_id % 4 = 0 THEN 'zh' ELSE 'en' END AS lang FROM events) r
      JOIN n USING ({_KEY}) WHERE coalesce(n.response_text, '') <> ''""",
    ("qa_logs",),
)
def cache_hits(t):
    req = t.events.selectExpr(
        "event_id", "user_id", "event_id % 50 AS article_id", "concat('question ', CAST(event_id % 11 AS STRING)) AS question", "CASE WHEN event_id % 4 = 0 THEN 'zh' ELSE 'en' END AS lang"
    )
    return qa.cache_hits(req, t.qa_logs).select("event_id", "qa_log_id", "response_text")


DAYS = [f"2024-01-{d:02d}" for d in range(2, 32)] + ["2024-02-01"]


def targets(t):
    return t.events.select(
        F.expr("CASE user_id % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'feishu' WHEN 2 THEN 'discord' ELSE 'notion' END").alias("target"),
        F.expr("CASE user_id % 4 WHEN 1 THEN 'zh' ELSE 'en' END").alias("lang"),
    ).distinct()


@query(
    "prd_9_delivery_claims",
    """WITH tg AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'feishu' WHEN 2 THEN 'discord' ELSE 'notion' END AS target, CASE user_id % 4 WHEN 1 THEN 'zh' ELSE 'en' END AS lang FROM events),
      d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-01', INTERVAL '1' DAY)) AS DATE) AS day),
      due AS (SELECT day, CAST(unnest(CASE WHEN day(day) = 1 THEN [30, 1] WHEN isodow(day) = 1 THEN [7, 1] ELSE [1] END) AS BIGINT) AS step_days FROM d),
      b AS (SELECT DISTINCT ON (anchor_date, step_days) * FROM briefs ORDER BY anchor_date, step_days, generated_at DESC, brief_id DESC),
      r AS (SELECT tg.target, due.day - 1 AS anchor_date, due.step_days, coalesce((due.step_days <> 1 OR b.generated_at >= CAST(due.day AS TIMESTAMP)) AND coalesce(CASE WHEN tg.lang = 'zh' THEN b.synthesis_zh ELSE b.synthesis_en END, '') <> '', false) AS ok
        FROM tg CROSS JOIN due LEFT JOIN b ON b.anchor_date = due.day - 1 AND b.step_days = due.step_days),
      z AS (SELECT *, bool_or(ok) OVER (PARTITION BY anchor_date, step_days) AS served FROM r)
      SELECT target, anchor_date, step_days, CASE WHEN ok THEN 'pending' ELSE 'skipped_empty_brief' END AS status FROM z WHERE (ok OR NOT served)
        AND NOT EXISTS (SELECT 1 FROM digest_sent s WHERE s.target = z.target AND s.anchor_date = z.anchor_date AND s.step_days = z.step_days)""",
    ("briefs", "digest_sent"),
)
def delivery_claims(t):
    return digest.claims(targets(t), t.briefs, t.digest_sent, DAYS)


@query(
    "prd_10_delivery_summary",
    """SELECT anchor_date, step_days, count(*) AS targets, count(*) FILTER (WHERE st = 'pending') AS pending, count(*) FILTER (WHERE st = 'sent') AS sent, count(*) FILTER (WHERE st = 'failed') AS failed, count(*) FILTER (WHERE st = 'skipped_empty_brief') AS skipped_empty_brief FROM (
      SELECT anchor_date, step_days, CASE WHEN target = 'slack' THEN 'failed' WHEN target = 'feishu' THEN 'sent' ELSE status END AS st FROM digest_sent) x GROUP BY 1, 2""",
    ("digest_sent",),
)
def delivery_summary(t):
    results = t.digest_sent.where("target IN ('slack', 'feishu')").select("target", "anchor_date", "step_days", F.when(F.col("target") == "slack", "500").alias("error")).distinct()
    # a target may have several rows per day in the fixture, so results join them all
    return digest.summary(digest.outcomes(t.digest_sent, results))


@query(
    "prd_11_merge_bios",
    """WITH old AS (SELECT lower(handle) AS handle, bio FROM sources WHERE bio IS NOT NULL), new AS (SELECT 'handle' || CAST(user_id AS VARCHAR) AS handle, max('user bio') AS bio FROM events GROUP BY 1)
      SELECT * FROM old UNION ALL SELECT * FROM new WHERE handle NOT IN (SELECT handle FROM old)""",
    ("sources",),
)
def merge_bios(t):
    new = t.events.select(F.concat(F.lit("Handle"), F.col("user_id").cast("string")).alias("handle"), F.lit("user bio").alias("bio"))
    return feeds.merge_bios(t.sources.where("bio IS NOT NULL"), new)


@query(
    "prd_12_windows",
    """WITH a AS (SELECT i AS idx, DATE '2024-01-31' - CAST(i * 7 AS INTEGER) AS anchor FROM (SELECT unnest(generate_series(0, 5)) AS i) s)
      SELECT idx, anchor, anchor - 6 AS start, anchor + 1 AS "end", (SELECT count(*) FROM news n WHERE CAST(coalesce(n.published_at, n.created_at) AS DATE) >= a.anchor - 6 AND CAST(coalesce(n.published_at, n.created_at) AS DATE) < a.anchor + 1) AS articles FROM a""",
    ("news",),
)
def windows(t):
    return feed.windows(t.news, AS_OF[:10], 7, "2023-12-28")
