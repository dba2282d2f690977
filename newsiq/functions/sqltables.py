"""Retrieval, feed and queue calls as table functions of Spark SQL.

:func:`register` names the tables as temporary views and creates the
functions over them, so that any SQL client of the session can write
``SELECT * FROM match_chunks(:embedding, match_count => 4)``.  Each call is
one plan with the view's scan at its bottom: filters and columns reach it, and
the best rows are cut below the exchange.  For a table of questions use the
batch operators; a ``LATERAL`` call per question compares every row of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsiq.operators.retrieval import RANK_DIGITS, SUMMARY_FIELDS, TITLE_FIELDS
from newsiq.plans.analysis import MIN_CHARS
from newsiq.plans.feed import THREAD_TYPES
from newsiq.plans.queue import MAX_RETRIES

#: The tables that the functions read.
VIEWS = ("articles", "article_vectors", "analysis_vectors", "chunks", "sources", "raw_items", "analyses")


def _cosine(a: str, b: str) -> str:
    """Cosine similarity of two vectors in double precision; 0 for a zero vector, as in the batch search."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (m, n) -> CAST(m AS DOUBLE) * CAST(n AS DOUBLE)), 0D, (s, m) -> s + m)"
    return f"round(coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D), 0D), {RANK_DIGITS})"


def _grams(x: str) -> str:
    words = rf"filter(split({x}, '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
    return f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"


def _similarity(a: str, b: str) -> str:
    return f"element_at(transform(array(size(array_intersect({a}, {b}))), n -> coalesce(n / nullif(size({a}) + size({b}) - n, 0), 0D)), 1)"


def _best(body: str, key: str, order: str, count: str, columns: str, rank: str = "rank") -> str:
    """The first ``count`` rows of ``body`` by ``order``, at least one."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}, {key}) AS {rank} FROM ({body})) WHERE {rank} <= greatest({count}, 1)"


def _definitions(v: dict[str, str]) -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, columns, body) of every function over the views ``v``."""
    near = lambda view, more="": f"SELECT article_id, {_cosine('embedding', 'query_embedding')} AS score{more} FROM {v[view]} t WHERE embedding IS NOT NULL"
    ready = f"SELECT article_id FROM {v['analysis_vectors']} WHERE status = 'ready' AND embedding IS NOT NULL"
    analysed = _best(f"{near('analysis_vectors')} AND status = 'ready'", "article_id", "score DESC", "match_count", "article_id, score, 'deep_analysis' AS embedding_source")
    plain = _best(f"{near('article_vectors')} AND NOT EXISTS (SELECT 1 FROM ({ready}) r WHERE r.article_id = t.article_id)", "article_id", "score DESC", "match_count", "article_id, score, 'daily_news' AS embedding_source")
    hits = _best(
        f"SELECT chunk_id, article_id, chunk_index, {_cosine('embedding', 'query_embedding')} AS score FROM {v['chunks']}"
        " WHERE embedding IS NOT NULL AND (model IS NULL OR embedding_model = model) AND (version IS NULL OR chunking_version = version)",
        "chunk_id", "score DESC", "match_count * greatest(overfetch, 1)", "chunk_id, article_id, chunk_index, score, chunk_rank", "chunk_rank",
    )
    per_article = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_rank) AS nth FROM ({hits})) WHERE nth = 1"
    fields = [*TITLE_FIELDS, *SUMMARY_FIELDS]
    terms = "array_distinct(slice(filter(transform(query_terms, t -> lower(trim(t))), t -> length(t) >= 2), 1, 10))"
    found = " OR ".join(f"contains({f}, t)" for f in fields)
    low = ", ".join(f"lower(coalesce({f}, '')) AS {f}" for f in fields)
    matched = f"SELECT *, filter({terms}, t -> {found}) AS hit FROM (SELECT id AS article_id, {low} FROM {v['articles']})"
    # the trigrams of each distinct text are bound once per row, as the optimizer would copy a plain column into the inner function
    sets = ", ".join(f"'{name}', transform(array_distinct(array({', '.join(group)})), f -> {_grams('f')})" for name, group in (("t", TITLE_FIELDS), ("s", SUMMARY_FIELDS)))
    best = ", ".join(f"{w} * array_max(transform(r.{name}, g -> {_similarity('g', 'tg')}))" for name, w in (("t", 4), ("s", 2)))
    total = f"aggregate(transform(transform(hit, t -> {_grams('t')}), tg -> greatest({best})), 0D, (s, x) -> s + x)"
    scored = f"SELECT article_id, element_at(transform(array(named_struct({sets})), r -> round({total}, {RANK_DIGITS})), 1) AS score FROM ({matched}) WHERE size(hit) > 0"
    inside = "n.published_at >= date_start AND n.published_at < date_end OR n.published_at IS NULL AND n.created_at >= date_start AND n.created_at < date_end"
    before = f"(SELECT max(created_at) AS at FROM {v['articles']} WHERE id = page_cursor)"  # one row
    page = _best(
        f"SELECT n.* FROM {v['articles']} n CROSS JOIN {before} c WHERE ({inside}) AND (feed_category IS NULL OR n.category = feed_category) AND (page_cursor IS NULL OR n.created_at < c.at) AND EXISTS (SELECT 1 FROM {v['sources']} s WHERE s.source_id = n.source_id)",
        "id DESC", "created_at DESC", "page_size", "*",
    )
    thread = ", ".join(f"'{t}'" for t in THREAD_TYPES)
    day = lambda t: f"to_date(convert_timezone('UTC', time_zone, {t}))"
    tier = f"CASE WHEN {day('published_at')} = {day('as_of')} THEN 0 WHEN published_at IS NULL AND {day('fetched_at')} = {day('as_of')} THEN 1 ELSE 2 END"
    return {
        "match_articles": ("query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT 10", "article_id BIGINT, score DOUBLE, rank INT", _best(near("article_vectors"), "article_id", "score DESC", "match_count", "article_id, score, rank")),
        "match_articles_prefer_analysis": (
            "query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT 5", "article_id BIGINT, score DOUBLE, embedding_source STRING, rank INT",
            _best(f"({analysed}) UNION ALL ({plain})", "article_id, embedding_source", "score DESC", "match_count", "article_id, score, embedding_source, rank"),
        ),
        "match_chunks": (
            "query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT 4, overfetch INT DEFAULT 5, version STRING DEFAULT NULL, model STRING DEFAULT NULL",
            "article_id BIGINT, chunk_id BIGINT, chunk_index BIGINT, score DOUBLE, chunk_rank INT, article_rank INT",
            _best(per_article, "chunk_rank", "score DESC", "match_count", "article_id, chunk_id, CAST(chunk_index AS BIGINT), score, chunk_rank, article_rank", "article_rank"),
        ),
        "match_articles_lexical": ("query_terms ARRAY<STRING>, match_count INT DEFAULT 10", "article_id BIGINT, score DOUBLE, rank INT", _best(f"SELECT * FROM ({scored}) WHERE score > 0", "article_id", "score DESC", "match_count", "article_id, score, rank")),
        "fetch_grouped_feed": (
            "date_start TIMESTAMP_NTZ, date_end TIMESTAMP_NTZ, feed_category STRING DEFAULT NULL, page_size INT DEFAULT 10, page_cursor BIGINT DEFAULT NULL",
            "id BIGINT, title_en STRING, title_zh STRING, summary_en STRING, summary_zh STRING, source_type STRING, source_id BIGINT, thread_group STRING, url STRING, published_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, questions STRING, next_cursor BIGINT",
            f"WITH page AS ({page}) SELECT p.id, coalesce(p.title_en, p.title), coalesce(p.title_zh, p.title), coalesce(p.summary_en, p.summary), coalesce(p.summary_zh, p.summary), s.source_type, p.source_id, "
            f"CASE WHEN s.source_type IN ({thread}) THEN s.handle END, p.url, p.published_at, p.created_at, p.questions, (SELECT min_by(id, struct(created_at, id)) FROM page) FROM page p JOIN {v['sources']} s ON s.source_id = p.source_id ORDER BY p.created_at DESC, p.id DESC",
        ),
        "claim_raw_batch": (
            "as_of TIMESTAMP_NTZ, batch_size INT DEFAULT 5, time_zone STRING DEFAULT 'America/New_York'", "id BIGINT, tier INT, place INT",
            _best(f"SELECT id, fetched_at, {tier} AS tier FROM {v['raw_items']} WHERE status = 'pending'", "id", "tier, fetched_at", "batch_size", "id, tier, place", "place"),
        ),
        "claim_analysis_batch": (
            "batch_size INT DEFAULT 5", "analysis_id BIGINT, article_id BIGINT, place INT",
            _best(
                f"SELECT a.analysis_id, a.article_id, a.created_at FROM {v['analyses']} a WHERE a.status IN ('pending', 'error') AND a.retry_count < {MAX_RETRIES}"
                f" AND EXISTS (SELECT 1 FROM {v['articles']} n WHERE n.id = a.article_id AND length(n.article_content) > {MIN_CHARS})",
                "analysis_id", "created_at", "batch_size", "analysis_id, article_id, place", "place",
            ),
        ),
    }


def register(spark: SparkSession, prefix: str = "", **tables: DataFrame) -> list[str]:
    """Create the functions whose tables are given, and return their names.

    ``tables`` are some of ``VIEWS``; they become temporary views with
    ``prefix`` before their name.  A function is created if all views that it
    reads are among them; calling again replaces views and functions.
    """
    unknown = set(tables) - set(VIEWS)
    if unknown:
        raise ValueError(f"no table of these functions: {', '.join(sorted(unknown))}")
    names = {name: f"{prefix}{name}" for name in VIEWS}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    marked = _definitions({name: f"\0{name}\0" for name in VIEWS})
    made = []
    for function, (parameters, columns, body) in marked.items():
        needed = [name for name in VIEWS if f"\0{name}\0" in body]
        if all(name in tables for name in needed):
            for name in needed:
                body = body.replace(f"\0{name}\0", names[name])
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
            made.append(function)
    return made
