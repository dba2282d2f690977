"""Table functions called from SQL."""

import datetime as dt

import pytest

from newsiq.functions import sqltables
from newsiq.operators import retrieval as rt

DAY = dt.datetime(2024, 3, 5)


@pytest.fixture(scope="module")
def session(spark):
    text = "id long, title string, title_en string, title_zh string, summary string, summary_en string, summary_zh string, article_content string, category string, source_id long, url string, published_at timestamp_ntz, created_at timestamp_ntz, questions string"
    rows = [(i, f"title {w}", None, None, f"summary of {w} {i}", None, None, "x" * (600 if i % 2 else 10), "c" if i < 5 else "d", i % 3, f"u{i}", None if i == 4 else DAY + dt.timedelta(hours=i), DAY + dt.timedelta(minutes=i // 2), None) for i, w in enumerate(["solar", "solar panel", "wind", "windmill", "rain", "snow", "sun"])]
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])]
    chunks = [(i, i // 2, i, [float(i), 1.0], "v1" if i < 4 else "v2", "m") for i in range(6)]
    made = sqltables.register(
        spark, "t_",
        articles=spark.createDataFrame(rows, text),
        article_vectors=spark.createDataFrame(vectors, "article_id long, embedding array<double>"),
        analysis_vectors=spark.createDataFrame([(1, "ready", [1.0, 0.1]), (5, "pending", [1.0, 0.0])], "article_id long, status string, embedding array<double>"),
        chunks=spark.createDataFrame(chunks, "chunk_id long, article_id long, chunk_index int, embedding array<double>, chunking_version string, embedding_model string"),
        sources=spark.createDataFrame([(0, "apify_tweet", "@a"), (1, "rss", "@b"), (2, "rss", None)], "source_id long, source_type string, handle string"),
        raw_items=spark.createDataFrame([(1, "pending", None, DAY), (2, "pending", DAY, DAY), (3, "done", DAY, DAY), (4, "pending", DAY - dt.timedelta(days=9), DAY - dt.timedelta(days=9))], "id long, status string, published_at timestamp_ntz, fetched_at timestamp_ntz"),
        analyses=spark.createDataFrame([(10, 1, "pending", 0, DAY), (11, 3, "error", 3, DAY), (12, 2, "pending", 0, DAY), (13, 5, "error", 2, DAY - dt.timedelta(1))], "analysis_id long, article_id long, status string, retry_count int, created_at timestamp_ntz"),
    )
    assert "match_chunks" in made and len(made) == 7
    return spark


def rows(session, sql):
    return [tuple(r) for r in session.sql(sql).collect()]


def test_nearest_articles_ties_by_id_and_defaults(session):
    assert rows(session, "SELECT article_id, score, rank FROM match_articles(array(1D, 0D), 3)") == [(0, 1.0, 1), (5, 1.0, 2), (2, 0.707106781, 3)]
    assert len(rows(session, "SELECT * FROM match_articles(match_count => 0, query_embedding => array(1D, 0D))")) == 1
    assert len(rows(session, "SELECT * FROM match_articles(array(1D, 0D))")) == 5
    assert rows(session, "SELECT score FROM match_articles(array(1D, 0D)) WHERE article_id = 3") == [(0.0,)]


def test_chunks_by_version_model_and_overfetch(session):
    got = rows(session, "SELECT article_id, chunk_id, article_rank FROM match_chunks(array(1D, 0D), 2, version => 'v1', model => 'm')")
    assert got == [(1, 3, 1), (0, 1, 2)]
    assert rows(session, "SELECT count(*) FROM match_chunks(array(1D, 0D), 2, overfetch => 1)") == [(1,)]
    assert rows(session, "SELECT q, article_id FROM VALUES (1, array(1D, 0D)), (2, array(0D, 1D)) AS c(q, e), LATERAL match_chunks(c.e, 1) ORDER BY q") == [(1, 2), (2, 0)]


def test_analysis_vectors_first(session):
    got = rows(session, "SELECT article_id, embedding_source FROM match_articles_prefer_analysis(array(1D, 0D), 3)")
    assert got == [(0, "daily_news"), (5, "daily_news"), (1, "deep_analysis")]


def test_lexical_equals_the_batch_search(session):
    terms = [(1, t) for t in ("solar", "wind", "o")]
    batch = rt.lexical(session.createDataFrame([(1,)], "query_id long"), session.table("t_articles").withColumnRenamed("id", "article_id"), 5, terms=session.createDataFrame(terms[:2], "query_id long, term string"))
    got = rows(session, "SELECT article_id, score, rank FROM match_articles_lexical(array(' Solar', 'wind', 'o', 'SOLAR '), 5)")
    assert got == [(r.article_id, r.score, r["rank"]) for r in batch.orderBy("rank").collect()] and len(got) == 4


def test_feed_pages_follow_the_cursor(session):
    call = "SELECT id, thread_group, title_en, next_cursor FROM fetch_grouped_feed(TIMESTAMP_NTZ '2024-03-05 00:00:00', TIMESTAMP_NTZ '2024-03-06 00:00:00'{})"
    assert [r[0] for r in rows(session, call.format(""))] == [6, 5, 4, 3, 2, 1, 0]
    first = rows(session, call.format(", page_size => 2"))
    assert [(r[0], r[3]) for r in first] == [(6, 5), (5, 5)] and first[0][1] == "@a" and first[1][1] is None
    assert [r[0] for r in rows(session, call.format(", page_size => 2, page_cursor => 5"))] == [3, 2]
    assert [r[0] for r in rows(session, call.format(", 'c', 10"))] == [4, 3, 2, 1, 0]
    assert rows(session, call.format(", page_cursor => 99")) == []


def test_claims(session):
    assert rows(session, "SELECT id, tier FROM claim_raw_batch(TIMESTAMP_NTZ '2024-03-05 12:00:00', 2, 'UTC') ORDER BY place") == [(2, 0), (1, 1)]
    assert rows(session, "SELECT analysis_id FROM claim_analysis_batch(2) ORDER BY place") == [(13,), (10,)]


def test_only_functions_of_the_given_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "article_id long, embedding array<float>")
    assert sqltables.register(spark, "u_", article_vectors=vectors) == ["match_articles"]
    with pytest.raises(ValueError, match="nothing"):
        sqltables.register(spark, nothing=vectors)
