"""Catalog: scans, source registry, pages, write rules, queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.sqltext import CANON, SQUEEZE
from newsiq.catalog.tables import AS_OF
from newsiq.operators import sinks
from newsiq.plans import analysis as an
from newsiq.plans import queue as qu
from newsiq.sources import feeds, pages, tables

TS = f"TIMESTAMP '{AS_OF}'"


@query("src_1_read_table", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 40")
def read_table(t):
    df = tables.read_table(t.spark, t.sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_quantity"])
    return df.where("l_quantity > 40").select("l_orderkey", "l_extendedprice")


@query(
    "src_2_active_sources",
    "SELECT source_id, name, source_type FROM sources WHERE is_active AND source_type IN ('rss','wechat','official_rss','reddit','youtube')",
    ("sources",),
)
def active_sources(t):
    return tables.active_sources(t.sources).select("source_id", "name", "source_type")


@query(
    "src_5_since_cursor",
    f"""SELECT r.id, r.source_id FROM raw r JOIN (SELECT s.source_id, coalesce(m.newest, {TS} - INTERVAL '25' HOUR) AS since
      FROM sources s LEFT JOIN (SELECT source_id, max(published_at) AS newest FROM raw WHERE status = 'done' GROUP BY source_id) m USING (source_id)) c
      USING (source_id) WHERE r.published_at >= c.since""",
    ("sources", "raw"),
)
def since_cursor(t):
    cursor = tables.since_cursor(t.raw.where("status = 'done'"), t.sources, AS_OF)
    return tables.newer_than_cursor(t.raw, cursor).select("id", "source_id")


def _clean_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, ch in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " ")):
        out = f"replace({out}, '&{name};', '{ch}')"
    return SQUEEZE(out)


def _block_sql(tag: str) -> str:
    return f"nullif(regexp_extract(html, '<{tag}\\b[^>]*>.*?</{tag}>', 0, 'is'), '')"


_NOISE = "coalesce(" + _block_sql("article") + ", " + _block_sql("main") + ", html)"
for _tag in ("script", "style", "nav", "header", "footer", "aside", "form"):
    _NOISE = f"regexp_replace({_NOISE}, '<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'gis')"
_ALT = "|".join(f"<{x}\\b[^>]*>.*?</{x}>" for x in ("h1", "h2", "h3", "p"))


@query(
    "src_6_readable_text",
    f"""SELECT page_id, coalesce(CASE WHEN len(parts) > 0 THEN list_reduce(parts, lambda a, b: CASE WHEN length(a) >= 12000 THEN a ELSE a || ' ' || b END) END, '') AS readable
      FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all({_NOISE}, '{_ALT}', 0, 'is'), lambda b: {_clean_sql('b')}), lambda c: length(c) > 20) AS parts FROM pages) x""",
)
def readable_text(t):
    return t.spread_out(t.pages).select("page_id", pages.readable_text("html").alias("readable"))


@query(
    "src_7_outlinks",
    f"""SELECT DISTINCT page_id, {CANON("u")} AS link FROM (
      SELECT page_id, base, CASE WHEN starts_with(href, '/') THEN regexp_extract(base, '^[a-z]+://[^/?#]+', 0) || href ELSE href END AS u
      FROM (SELECT page_id, url AS base, trim(unnest(regexp_extract_all(html, '<a\\b[^>]*?href="([^"]*)"', 1, 'is'))) AS href FROM pages) h WHERE href <> '') l
      WHERE regexp_extract(u, '://([^/?#]+)', 1) = regexp_extract(base, '://([^/?#]+)', 1)""",
)
def outlinks(t):
    return pages.outlinks(t.spread_out(t.pages), path_regex="^/")


@query(
    "src_8_published_at",
    """SELECT page_id, strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER), '%Y-%m-%dT00:00:00.000Z') AS published_at FROM pages""",
)
def published_at(t):
    # the fixture pages carry no dates, so each gets one in one of four places
    day = F.expr("date_add(DATE '2024-01-01', CAST(page_id % 300 AS INT))")
    iso, words = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMM d, yyyy")
    head = (
        F.when(F.expr("page_id % 4 = 0"), F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('T00:00:00Z">')))
        .when(F.expr("page_id % 4 = 1"), F.concat(F.lit("<time class='d' datetime='"), iso, F.lit("'></time>")))
        .when(F.expr("page_id % 4 = 2"), F.concat(F.lit('<script type="application/ld+json">{"@type":"Article","datePublished":"'), iso, F.lit('"}</script>')))
        .otherwise(F.concat(F.lit("<p>Published "), words, F.lit("</p>")))
    )
    return pages.published_at(t.pages.withColumn("html", F.concat(head, "html"))).select("page_id", "published_at")


# ---------------------------------------------------------------- write rules


@query(
    "snk_1_insert_ignore",
    f"""WITH batch AS (SELECT id, {CANON('url')} AS url FROM items WHERE trust_tier = 'secondary'),
      target AS (SELECT min(id) AS id, {CANON('url')} AS url FROM items WHERE trust_tier = 'official' GROUP BY 2)
      SELECT id, url FROM target UNION ALL
      SELECT min(b.id) AS id, b.url FROM batch b WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.url = b.url) GROUP BY b.url""",
    ("items",),
)
def insert_ignore(t):
    from newsiq.functions import text as tx

    rows = t.items.select("id", "trust_tier", tx.canonical_url("url").alias("url"))
    target = rows.where("trust_tier = 'official'").groupBy("url").agg(F.min("id").alias("id"))
    return sinks.insert_ignore(target, rows.where("trust_tier = 'secondary'").drop("trust_tier"), "url", [F.col("id")]).select("id", "url")


_OLD = "SELECT id, title, score FROM news WHERE category <> 'industry'"
_NEW = "SELECT id, concat('new ', title) AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS score FROM news WHERE title_en IS NOT NULL"


@query(
    "snk_2_upsert",
    f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title,
      CASE WHEN n.id IS NOT NULL THEN n.score ELSE o.score END AS score FROM o FULL JOIN n ON o.id = n.id""",
    ("news",),
)
def upsert(t):
    return sinks.upsert(t.sql(_OLD, "news"), t.sql(_NEW, "news"), "id", [F.col("title")])


@query(
    "snk_3_upsert_columns",
    f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN n.title ELSE o.title END AS title,
      coalesce(n.score, o.score) AS score FROM o FULL JOIN n ON o.id = n.id""",
    ("news",),
)
def upsert_columns(t):
    return sinks.upsert(t.sql(_OLD, "news"), t.sql(_NEW, "news"), "id", [F.col("title")], update_cols=["score"])


@query(
    "snk_4_enqueue_analysis",
    """SELECT n.id AS article_id, CASE WHEN length(trim(coalesce(n.article_content, ''))) > 500 THEN 'pending' ELSE 'ineligible' END AS status, 'insert' AS action
      FROM news n WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.article_id = n.id)
      UNION ALL SELECT n.id, 'pending', 'requeue' FROM news n JOIN analysis a ON a.article_id = n.id
      WHERE a.status = 'ineligible' AND length(trim(coalesce(n.article_content, ''))) > 500""",
    ("news", "analysis"),
)
def enqueue(t):
    return an.enqueue(t.news, t.analysis).select("article_id", "status", "action")


@query(
    "snk_5_update_from",
    """SELECT n.id, CASE WHEN s.category IS NOT NULL AND n.category IS DISTINCT FROM s.category THEN s.category ELSE n.category END AS category,
      s.category IS NOT NULL AND n.category IS DISTINCT FROM s.category AS changed
      FROM news n LEFT JOIN (SELECT source_id, CASE WHEN source_id % 5 = 0 THEN NULL ELSE category END AS category FROM sources) s USING (source_id)""",
    ("news", "sources"),
)
def update_from(t):
    src = t.sources.selectExpr("source_id", "CASE WHEN source_id % 5 = 0 THEN NULL ELSE category END AS category")
    return sinks.update_from(t.news.select("id", "source_id", "category"), src, "source_id", ["category"]).drop("source_id")


@query(
    "snk_6_requeue",
    f"""SELECT r.id, 'pending' AS status, CAST(0 AS BIGINT) AS retry_count FROM raw r JOIN sources s USING (source_id)
      WHERE s.source_type = 'arxiv' AND r.status = 'error' AND r.last_error = 'INSUFFICIENT_CONTENT' AND r.fetched_at > {TS} - INTERVAL '20' DAY
      AND NOT EXISTS (SELECT 1 FROM news n WHERE n.questions IS NOT NULL AND n.raw_ingestion_id = r.id)""",
    ("news", "raw", "sources"),
)
def requeue(t):
    out = qu.requeue(t.raw, t.sources, t.news.where("questions IS NOT NULL"), "arxiv", "INSUFFICIENT_CONTENT", 20, AS_OF)
    return out.select("id", "status", "retry_count")


@query(
    "snk_7_merge_map",
    """SELECT k AS source_id, coalesce(nh, oh) AS handle, coalesce(ob, 'none') AS bio, nx AS extra FROM (
      SELECT coalesce(o.source_id, n.source_id) AS k, o.handle AS oh, o.bio AS ob, n.handle AS nh, n.extra AS nx FROM
      (SELECT * FROM sources WHERE source_type <> 'youtube') o FULL JOIN
      (SELECT source_id, concat('h', CAST(source_id AS VARCHAR)) AS handle, 'x' AS extra FROM sources WHERE bio IS NULL) n ON o.source_id = n.source_id) z""",
    ("sources",),
)
def merge_map(t):
    old = t.sources.where("source_type <> 'youtube'").select(
        "source_id", F.map_filter(F.create_map(F.lit("handle"), "handle", F.lit("bio"), "bio"), lambda k, v: v.isNotNull()).alias("metadata")
    )
    new = t.sources.where("bio IS NULL").select(
        "source_id", F.create_map(F.lit("handle"), F.concat(F.lit("h"), F.col("source_id").cast("string")), F.lit("extra"), F.lit("x")).alias("metadata")
    )
    out = sinks.upsert_merge_map(old, new, "source_id", "metadata")
    at = lambda k: F.element_at("metadata", k)
    return out.select("source_id", at("handle").alias("handle"), F.coalesce(at("bio"), F.lit("none")).alias("bio"), at("extra").alias("extra"))


@query(
    "snk_8_patch_if_null",
    """SELECT s.id, coalesce(s.gone, p.gone) AS gone FROM (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' END AS gone FROM events) s
      LEFT JOIN (SELECT user_id AS id, min(ts) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id) p USING (id)""",
)
def patch_if_null(t):
    subs = t.events.select(F.col("user_id").alias("id")).distinct()
    subs = subs.withColumn("gone", F.expr("CASE WHEN id % 3 = 0 THEN TIMESTAMP_NTZ '2023-12-31 00:00:00' END"))
    return sinks.patch_if_null(subs, t.events.where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("gone")), "id", "gone")


# ---------------------------------------------------------------- gates over known rows


@query(
    "win_7_grade_authors",
    """SELECT author, url, score FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, url) AS rn FROM (
        SELECT concat('u', CAST(user_id AS VARCHAR)) AS author, concat('https://x.com/U', CAST(user_id AS VARCHAR), '/status/', CAST(event_id AS VARCHAR)) AS url,
          CAST(floor(value) AS BIGINT) + event_id % 7 AS score FROM events WHERE NOT (event_type = 'view' AND value < 10) AND event_type IN ('view', 'click')) p) z WHERE rn <= 3""",
)
def grade_authors(t):
    posts = t.events.select(
        "event_id", F.expr("event_type = 'view' AND value < 10").alias("seen"),
        F.concat(F.lit("https://x.com/U"), F.col("user_id").cast("string"), F.lit("/status/"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("about "), F.when(F.col("event_type").isin("view", "click"), "GPT").otherwise(F.col("event_type"))).alias("raw_content"),
        F.floor("value").cast("long").alias("likes"), (F.col("event_id") % 7).alias("retweets"),
    )
    out = feeds.grade_authors(posts, posts.where("raw_content = 'about GPT' AND seen").select("url"))
    return out.select("author", "url", (F.col("likes") + F.col("retweets")).alias("score"))


@query(
    "win_8_limit_new_official",
    f"""WITH c AS (SELECT i.id, i.source_id, {CANON('i.url')} AS url, i.published_at, s.source_type FROM items i JOIN sources s USING (source_id)),
      known AS (SELECT DISTINCT url FROM c WHERE id IN (SELECT id FROM raw WHERE status = 'error')),
      o AS (SELECT * FROM c WHERE source_type = 'official_rss' AND published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '29' DAY
            AND url NOT IN (SELECT url FROM known)),
      f AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM (SELECT source_id, url, min(id) AS id FROM o GROUP BY 1, 2) g),
      u AS (SELECT min(struct_pack(id := id, s := source_id)) AS m, url FROM f WHERE rn <= 1 GROUP BY url)
      SELECT id, source_id, source_type FROM c WHERE source_type <> 'official_rss'
      UNION ALL SELECT m.id, m.s, 'official_rss' FROM u""",
    ("items", "sources", "raw"),
)
def limit_new_official(t):
    rows = t.items.join(t.sources.select("source_id", "source_type"), "source_id").select(
        "id", F.col("id").alias("ordinal"), "source_id", "source_type", "url", "published_at"
    )
    known = t.items.join(t.raw.where("status = 'error'").select("id"), "id", "left_semi")
    out = feeds.limit_new_official(rows, known, as_of=AS_OF)
    return out.select("id", "source_id", "source_type")


@query(
    "prj_27_recent",
    "SELECT id FROM items WHERE published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '9' DAY",
    ("items",),
)
def recent(t):
    return tables.recent(t.items, "2024-01-31 13:00:00", days=10).select("id")
