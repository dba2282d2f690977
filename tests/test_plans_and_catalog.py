"""Shapes of physical plans, and every named query against its SQL."""

import pytest
from compare import connect, diff
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from newsiq import catalog
from newsiq.catalog.tables import Tables
from newsiq.operators import retrieval, windows
from newsiq.operators.lineage import cut, shared_folder
from newsiq.plans import feed

SMALL = "/root/testdata/sf0.001"
catalog.load()
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert diff(QUERIES[name](spark, SMALL), duck, SQL[name]) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 1


def test_scan_prunes_and_pushes(tables):
    text = plan(feed.new_since(tables.lineitem.withColumnRenamed("l_shipdate", "created_at"), "1998-01-01"))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "ReadSchema: struct<l_shipdate" in text
    text = plan(tables.news.select("id", "category"))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_top_per_group_limits_before_the_exchange(tables):
    text = plan(windows.top_per(tables.events, ["user_id"], [F.col("ts").desc()], 3))
    below = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below


def test_chunk_search_shuffles_winners_only(tables):
    q = tables.cases.select(F.col("case_id").alias("query_id"), "query_embedding")
    text = plan(retrieval.chunk_dense(q, tables.chunks, 10, model="m1"))
    # the packed queries are the only side that moves; they meet packed corpus blocks, not rows
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text and text.count("MapInArrow") == 3


# queries without a search, whose packed query blocks meet packed corpus blocks
@pytest.mark.parametrize("name", ["rep_5_miss_audit", "rep_11_corpus_health", "prd_4_brief_selection", "prd_9_delivery_claims", "joi_8_or_of_keys"])
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_column_logic_stays_in_the_jvm(spark):
    for name in ("prj_1_is_ai_relevant", "prj_5_normalize_text", "prj_7_usable_score", "src_6_readable_text", "chk_2_build", "evl_11_taxonomy"):
        assert "Python" not in plan(QUERIES[name](spark, SMALL)), name


def test_cut_uses_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = cut(spark.range(5).withColumn("x", F.lit("a")))
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark)) and df.count() == 5
