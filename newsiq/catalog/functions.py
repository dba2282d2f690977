"""Catalog: calls of the SQL table functions, and counters kept from changes."""

from __future__ import annotations

from newsiq.catalog import query
from newsiq.catalog.products import _PAGE
from newsiq.catalog.search import PREFER, chunk_sql, knn_sql, lexical_sql
from newsiq.functions import sqltables


def registered(t):
    """A session in which the functions read the tables of ``t``."""
    sqltables.register(
        t.spark, "newsiq_", articles=t.spread_out(t.news), article_vectors=t.article_vectors, analysis_vectors=t.analysis_vectors, chunks=t.chunks, sources=t.sources, raw_items=t.raw, analyses=t.analysis
    )
    t.cases.createOrReplaceTempView("newsiq_cases")
    return t.spark


@query(
    "udx_2_match_articles",
    f"WITH {knn_sql('h', 'article_vectors', 'article_id', 10)} SELECT article_id, round(score, 6) AS score, rank FROM h WHERE query_id = (SELECT min(case_id) FROM cases)",
    ("cases", "article_vectors"),
)
def match_articles(t):
    """The first question's nearest articles, called by name."""
    return registered(t).sql("SELECT article_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM match_articles((SELECT min_by(query_embedding, case_id) FROM newsiq_cases))")


@query(
    "udx_2_match_chunks",
    f"WITH {chunk_sql('h', 4)} SELECT query_id, article_id, chunk_id, round(score, 6) AS score, chunk_rank, article_rank FROM h WHERE query_id IN (SELECT case_id FROM cases ORDER BY case_id LIMIT 3)",
    ("cases", "chunks"),
)
def match_chunks(t):
    """The chunks of three questions, one lateral call each, with named arguments."""
    return registered(t).sql(
        "SELECT c.case_id AS query_id, article_id, chunk_id, round(score, 6) AS score, CAST(chunk_rank AS BIGINT) AS chunk_rank, CAST(article_rank AS BIGINT) AS article_rank "
        "FROM (SELECT case_id, query_embedding FROM newsiq_cases ORDER BY case_id LIMIT 3) c, LATERAL match_chunks(c.query_embedding, model => 'm1')"
    )


@query(
    "udx_2_match_prefer_analysis",
    f"WITH {PREFER} SELECT article_id, round(score, 6) AS score, embedding_source, rank FROM prefer WHERE query_id = (SELECT max(case_id) FROM cases)",
    ("cases", "article_vectors", "analysis_vectors"),
)
def match_prefer_analysis(t):
    """The last question's articles, analysis vectors first."""
    return registered(t).sql(
        "SELECT article_id, round(score, 6) AS score, embedding_source, CAST(rank AS BIGINT) AS rank FROM match_articles_prefer_analysis((SELECT max_by(query_embedding, case_id) FROM newsiq_cases), 10)"
    )


@query(
    "udx_2_match_lexical",
    f"WITH {lexical_sql('h', 10, question=chr(39) + 'the and hend er' + chr(39))} SELECT article_id, round(score, 6) AS score, rank FROM h WHERE query_id = (SELECT min(case_id) FROM cases)",
    ("cases", "news"),
)
def match_lexical(t):
    """The articles that four words find."""
    return registered(t).sql("SELECT article_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM match_articles_lexical(array('the', ' AND ', 'hend', 'er', 'x'), 10)")


@query(
    "udx_2_grouped_feed",
    f"""WITH {_PAGE} SELECT p.id, coalesce(p.title_en, p.title) AS title_en, coalesce(p.title_zh, p.title) AS title_zh, s.source_type, CASE WHEN s.source_type = 'apify_tweet' THEN s.handle END AS thread_group,
      p.url, p.created_at, (SELECT id FROM page ORDER BY created_at, id LIMIT 1) AS next_cursor FROM page p JOIN sources s USING (source_id)""",
    ("news", "sources"),
)
def grouped_feed(t):
    """A page of the grouped feed, called by name."""
    return registered(t).sql(
        "SELECT id, title_en, title_zh, source_type, thread_group, url, created_at, next_cursor FROM "
        "fetch_grouped_feed(TIMESTAMP_NTZ '2024-01-10 00:00:00', TIMESTAMP_NTZ '2024-01-20 00:00:00', 'industry', page_size => 20)"
    )


@query(
    "udx_2_claims",
    """SELECT 'analysis' AS queue, analysis_id AS id, row_number() OVER (ORDER BY a.created_at, analysis_id) AS place FROM analysis a JOIN news n ON n.id = a.article_id WHERE a.status IN ('pending', 'error') AND a.retry_count < 3
      AND n.article_content IS NOT NULL AND length(n.article_content) > 500 QUALIFY place <= 40""",
    ("analysis", "news"),
)
def claims(t):
    """The next analysis jobs, called by name."""
    return registered(t).sql("SELECT 'analysis' AS queue, analysis_id AS id, CAST(place AS BIGINT) AS place FROM claim_analysis_batch(40)")
