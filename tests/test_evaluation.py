"""Metrics, evidence rules, analyses, notes and plans with known results."""

import json

import pytest
from pyspark.sql import functions as F

from newsiq.operators import chunks, questions, retrieval
from newsiq.plans import analysis, evalset, metrics, quality

GOLD = "query_id int, article_id string, relevance_grade int, review_status string, evidence_role string"


def scores(spark, found, gold):
    c = spark.createDataFrame([(1, a, r) for a, r in found], "query_id int, article_id string, rank int")
    g = spark.createDataFrame([(1, a, n, "approved", role) for a, n, role in gold], GOLD)
    return metrics.per_case(c, g).first()


def test_metrics(spark):
    m = scores(spark, list(zip("xabcd", range(1, 6))), [("a", 3, None), ("b", 2, None), ("z", 2, None)])
    assert m.recall_at_3 == m.recall_at_5 == m.recall_at_10 == pytest.approx(2 / 3)
    assert m.mrr == 0.5 and m.hit_at_5 and 0 < m.ndcg_at_10 < 1


def test_repeated_chunks_count_once(spark):
    m = scores(spark, [("g", 1), ("g", 2), ("miss", 3)], [("g", 3, None)])
    assert (m.recall_at_3, m.recall_at_5, m.mrr) == (1, 1, 1) and m.ndcg_at_10 <= 1


def test_lower_grades_are_part_of_the_ideal(spark):
    m = scores(spark, [("s", 1), ("r", 2)], [("s", 2, None), ("r", 1, None)])
    assert m.recall_at_10 == 1 and m.ndcg_at_10 == pytest.approx(1)


def test_no_relevant_gold(spark):
    m = scores(spark, [("a", 1)], [("a", 1, None), ("b", 0, "hard_negative")])
    assert (m.recall_at_3, m.mrr, m.hit_at_5) == (0, 0, False)


def test_hard_negatives(spark):
    c = spark.createDataFrame([(1, "hard-a", 1), (1, "gold-a", 2), (1, "hard-b", 3)], "query_id int, article_id string, rank int")
    g = spark.createDataFrame([(1, "gold-a", 3, "approved", None), (1, "hard-a", 0, "approved", "hard_negative"), (1, "hard-b", 0, "approved", "hard_negative")], GOLD)
    r = metrics.hard_negatives(c, g).first()
    assert (r.hard_negatives_above_gold, r.best_gold_rank, r.best_hard_negative_rank, r.hard_negative_article_ids_above_gold) == (1, 2, 1, "hard-a")


def test_questions(spark):
    rows = spark.createDataFrame(
        [("a", "A", "hello", False, "en", "mid"), ("b", "B", "", False, "zh", "long"), ("c", "C", "skip me", True, "zh", "long")],
        "article_id string, title string, question string, stress_test boolean, lang string, cohort string",
    )
    kept = evalset.normalize_questions(rows).collect()
    assert [(r.question, r.case_type) for r in kept] == [("hello", "factual")]


def test_notes(spark):
    notes = ["plain historical note", '{"gold_policy":"approved_only"}', '{"notes_schema_version":"rag-eval-run-notes-v1","valid_for_strategy_selection":true,"invalid_reason":null,"corpus_health_run_id":"abc"}']
    rows = quality.parse_notes(spark.createDataFrame(list(enumerate(notes)), "i int, notes string")).orderBy("i").collect()
    assert [(r.valid_for_strategy_selection, r.invalid_reason, r.corpus_health_run_id) for r in rows] == [
        (False, "legacy_or_nonconforming_notes", None),
        (False, "legacy_or_nonconforming_notes", None),
        (True, None, "abc"),
    ]


def block(n=3):
    return {
        "facts": [{"text": f"fact {i}", "evidence": "opening"} for i in range(n)],
        "why_it_matters": "One. Two. Three.",
        "deeper_interpretation": "A. B. C. D. E.",
        "limitations_or_uncertainties": ["x", "y"],
    }


def test_analysis_rules(spark):
    good = {"article_type": "technical_report", "en": block(), "zh": block()}
    no_evidence = {**good, "en": {**block(), "facts": [{"text": "t"}] + block()["facts"][1:]}}
    short = {**good, "en": {**block(), "why_it_matters": "Too short."}}
    zh_only = {**good, "zh": {**block(), "limitations_or_uncertainties": ["x"]}}
    rows = [json.dumps(x) for x in (good, no_evidence, short, zh_only)] + ["[1]", "no json"]
    ok, bad = quality.validate_analysis(spark.createDataFrame(list(enumerate(rows)), "i int, j string"), "j")
    kept = ok.select("i", "analysis", analysis.to_text(F.col("analysis"), F.lit("A title")).alias("t"), analysis.to_prompt(F.col("analysis"), "zh").alias("p")).collect()
    assert [r.i for r in kept] == [0] and kept[0].analysis.article_type == "technical_report"
    assert kept[0].t.startswith("Title: A title\nArticle type: technical_report\nEN facts:\n- fact 0 (opening)") and "ZH limitations: x | y" in kept[0].t
    assert kept[0].p.startswith("[深度分析]\nFacts:\n1. fact 0 (opening)")
    errors = {r.i: r.error for r in bad.collect()}
    assert errors[1] == "en.facts[0].evidence must be a string"
    assert errors[2] == "en.why_it_matters must contain at least 3 sentences"
    assert errors[3] == "zh.limitations_or_uncertainties must contain 2-5 strings"
    assert errors[4] == errors[5] == "analysis must be an object"


def test_analysis_input(spark):
    p = spark.createDataFrame([("x" * 20,)], "c string").select(analysis.prepare("c", 10).alias("p")).first().p
    assert (len(p.content), p.input_chars, p.truncated) == (10, 20, True)


def test_rewrite(spark):
    q = "Did Ferro Labs buy gridCtl in May 2031?"
    df = spark.createDataFrame([(q,)], "question string")
    modes = {m: questions.rewrite(df, m).first() for m in ("entity_expansion", "none", "hyde", "decomposition", "odd")}
    assert modes["entity_expansion"].rewritten_query.startswith(q + "\n") and modes["entity_expansion"].accepted
    assert all(w in modes["entity_expansion"].rewritten_query.split("\n")[-1] for w in ("Did Ferro Labs", "gridCtl", "2031"))
    assert modes["none"].rewritten_query == q and modes["none"].drift_threshold == 0.82
    assert not modes["hyde"].accepted and modes["hyde"].effective_query == q
    assert modes["odd"].rewrite_mode == "none"


def test_terms(spark):
    row = spark.createDataFrame([("Wo ist Ferro北京西站时刻 am 12?",)], "q string").select(questions.lexical_terms("q").alias("l"), questions.entity_terms("q", ["西站"]).alias("e")).first()
    assert row.l == ["wo", "ist", "ferro北京西站时刻", "am", "12", "北京西站", "西站时刻", "时刻"]
    assert row.e == ["西站", "Wo", "Ferro", "12"]


def test_intents_and_plans(spark):
    rows = [("Was ist neu?",), ("Zürich vs Basel",)]
    got = questions.plan(spark.createDataFrame(rows, "question string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.intent, []).append(r.subquery_id)
    assert by == {"simple": ["sq1"], "comparison": ["sq1", "sq2"]}


def test_two_rounds(spark):
    plans = questions.plan(spark.createDataFrame([("wo liegt Ulm?",), ("Bonn vs Trier",), ("versus nothing",)], "question string"))

    def retriever(df, round_no):
        rows = df.select("plan_id", "subquery_id", F.lit("b").alias("article_id"), F.lit(None).cast("string").alias("chunk_id"), F.lit(1.0).alias("score_final"), "query")
        return rows.where("query like '%Ulm%'" if round_no == 1 else "query like '%Bonn%'")

    got = {r.intent + str(r.candidate_count): r for r in retrieval.two_rounds(plans, retriever).collect()}
    assert got["simple1"].stop_reason == "linear_simple_question" and got["simple1"].retrieval_rounds == 1
    assert got["comparison1"].stop_reason == "critique_retry_satisfied" and got["comparison1"].retrieval_rounds == 2
    assert got["comparison0"].stop_reason == "max_rounds_reached" and not got["comparison0"].answerable


def test_rerank(spark):
    c = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 0.0)], "query_id int, article_id string, rank int, score_final double")
    s = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "query_id int, index int, score double")
    rows = retrieval.rerank(c, s).orderBy("rank").collect()
    assert [(r.article_id, r.score_rerank) for r in rows] == [("b", 0.9), ("a", 0.2)]
    one_based = spark.createDataFrame([(1, 2, 80.0)], "query_id int, index int, score double")
    assert [r.article_id for r in retrieval.rerank_by_judge(c, one_based).orderBy("rank").collect()] == ["b", "a"]


def test_cache_key_depends_on_order(spark):
    rows = [(1, "Same  Q", "a", 1, "x"), (1, "Same  Q", "b", 2, "y"), (2, "same q", "b", 1, "y"), (2, "same q", "a", 2, "x"), (3, " same q ", "a", 1, "x"), (3, " same q ", "b", 2, "y")]
    df = spark.createDataFrame(rows, "query_id int, question string, article_id string, rank int, context string")
    keys = {r.query_id: r.cache_key for r in retrieval.cache_keys(df, "m").collect()}
    assert keys[1] == keys[3] != keys[2]


def test_chunker(spark):
    text = "A" * 2000 + "\n\n" + "B" * 1500 + "\n\n\n" + "C" * 50 + "\n\n"
    got = spark.createDataFrame([(text,), ("",), ("x" * 5000,)], "t string").select(chunks.split_chunks("t").alias("c")).collect()
    first = got[0].c
    assert [len(c.chunk_text) for c in first] == [2000, 600 + 2 + 1500 + 2 + 50]
    assert (first[0].char_start, first[0].char_end) == (0, 2000)
    assert first[1].char_start == 2002 - 600 and first[1].chunk_text.startswith("A" * 600 + "\n\nB")
    assert got[1].c == [] and [len(c.chunk_text) for c in got[2].c] == [5000]


def test_rrf_ignores_row_order(spark):
    a = spark.createDataFrame([(1, i, r) for r, i in enumerate([5, 3, 9], 1)], "query_id int, article_id int, rank int")
    b = spark.createDataFrame([(1, i, r) for r, i in enumerate([9, 5, 7], 1)], "query_id int, article_id int, rank int")
    x = [(r.article_id, r.rank) for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    y = [(r.article_id, r.rank) for r in retrieval.rrf([a.orderBy(F.rand(1)), b.repartition(3)]).orderBy("rank").collect()]
    assert x == y and x[0][0] == 5
