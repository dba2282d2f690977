"""Evaluation sets: questions, cases, evidence, hard negatives, taxonomy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx
from newsiq.operators import mining
from newsiq.operators import retrieval as rt
from newsiq.operators.sinks import upsert
from newsiq.operators.windows import latest_per, top_per
from newsiq.plans.metrics import is_hard_negative


# Patterns of question types, first match wins.
CASE_TYPES = (
    ("comparison", r"比较|对比|versus|vs\.?|compare"),
    ("temporal", "时间|日期|开庭|发布|when|date|timeline"),
    ("synthesis", "是否|能否|如何|why|how|impact|影响"),
)


def case_type(question: Column | str) -> Column:
    q = F.lower(F.coalesce(tx._c(question), F.lit("")))
    return F.coalesce(*[F.when(q.rlike(pattern), kind) for kind, pattern in CASE_TYPES], F.lit("factual"))


def normalize_questions(raw: DataFrame) -> DataFrame:
    """Usable questions with language, cohort and type; stress tests and blanks are dropped."""
    text = F.regexp_replace(F.coalesce("question", F.lit("")), r"^\s+|\s+$", "")
    rows = raw.where(~F.coalesce("stress_test", F.lit(False)) & (text != ""))
    chars = F.col("chars") if "chars" in raw.columns else F.lit(None).cast("long")
    return rows.select(
        "article_id", F.coalesce("title", F.lit("")).alias("title"), text.alias("question"),
        F.when(F.col("lang") == "en", "en").otherwise("zh").alias("lang"),
        F.when(F.col("cohort") == "long", "long").otherwise("mid").alias("cohort"),
        case_type("question").alias("case_type"), chars.alias("chars"),
    )


def seed_cases(cases: DataFrame, questions: DataFrame, news: DataFrame, eval_set_id: int) -> DataFrame:
    """Case table after seeding: questions whose article exists, one per (set, article, question)."""
    known = questions.join(news.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    rows = known.select(
        F.lit(eval_set_id).cast("long").alias("eval_set_id"), F.col("article_id").alias("primary_article_id"),
        "question", "lang", "case_type", "cohort", F.lit("eval_json").alias("case_source"),
    )
    key = ["eval_set_id", "primary_article_id", "question"]
    return upsert(cases.select(*rows.columns), rows, key, [F.col("lang"), F.col("case_type"), F.col("cohort")])


def effective_gold(gold: DataFrame, allow_pending: bool = True) -> DataFrame:
    """Approved evidence; pending evidence only for cases without any approved row."""
    approved = gold.where(F.col("review_status") == "approved")
    if not allow_pending:
        return approved
    rest = gold.where(F.col("review_status") == "pending").join(approved.select("case_id"), "case_id", "left_anti")
    return approved.unionByName(rest)


def runnable(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases with at least one piece of relevant evidence."""
    return cases.join(gold.where(F.col("relevance_grade") >= 2).select("case_id"), "case_id", "left_semi")


def clamp_grade(x: Column) -> Column:
    """Nearest grade from 0 to 3; not a number gives 0."""
    n = x.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(3), F.floor(n + 0.5))), F.lit(0)).cast("long")


WEIGHTS = {"vector": 1.0, "lexical": 1.0, "chunk": 1.0, "primary_article_baseline": 2.0}


def candidates_for_labeling(lists: list[DataFrame], cases: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Fused candidates per case to be graded, with the review state already known.

    The case's own article enters as a list of weight 2.  Known labels keep
    their grade and status; hard negatives stay at grade 0.
    """
    own = cases.where(F.col("primary_article_id").isNotNull()).select(
        F.col("case_id").alias("query_id"), F.col("primary_article_id").alias("article_id"), F.lit(1).alias("rank"),
        F.lit("primary_article_baseline").alias("source_key"),
    )
    fused = rt.weighted_rrf([lists[0], own, *lists[1:]], WEIGHTS, 50).where(F.col("rank") <= max(k, 20))
    known = gold.select(F.col("case_id").alias("query_id"), "article_id", "relevance_grade", "review_status", "evidence_role")
    out = fused.join(known, ["query_id", "article_id"], "left")
    grade = F.when(is_hard_negative(), 0).otherwise(F.coalesce(F.col("relevance_grade"), F.lit(0)))
    return out.select(
        F.col("query_id").alias("case_id"), "article_id", F.col("rank").cast("long").alias("rank"), "score_final", "fusion_sources",
        clamp_grade(grade.cast("double")).alias("relevance_grade"), F.coalesce("review_status", F.lit("pending")).alias("review_status"),
    )


# ---------------------------------------------------------------- hard negatives


def _title(prefix: str = "") -> Column:
    return F.coalesce(f"{prefix}title_en", f"{prefix}title_zh", f"{prefix}title", F.lit(""))


def _summary() -> Column:
    return F.coalesce("summary_en", "summary_zh", F.lit(""))


def _words(text: Column) -> Column:
    """Distinct words of at least three letters or digits, other characters removed."""
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3))


def hard_negatives(
    cases: DataFrame, gold: DataFrame, news: DataFrame, retrieved: DataFrame, n: int = 10
) -> DataFrame:
    """Up to ``n`` proposals of distracting articles per case.

    The pool of a case holds articles of its article's source, of its category,
    with the first word of its title in theirs, or retrieved in its top 20
    before; evidence of the case and its own article are left out.  A proposal
    shares a word with the question or the evidence, or an entity tag of the
    case (optional ``entity_tags``), or was retrieved.

    Blocks of cases meet the corpus where it lies; it is not shuffled, and a
    task's best per case leave it.
    """
    approved = gold.where((F.col("review_status") == "approved") & (F.col("relevance_grade") >= 2))
    art = news.select(
        F.col("id").alias("article_id"), "source_id", "category", "published_at", "created_at", _title().alias("candidate_title"),
        F.lower(F.concat(_title(), F.lit(" "), _summary())).alias("candidate_text"),
    )
    own = art.select(
        F.col("article_id").alias("primary_article_id"), F.col("source_id").alias("p_source"), F.col("category").alias("p_category"),
        F.col("published_at").alias("p_published"), F.lower(F.split_part("candidate_title", F.lit(" "), F.lit(1))).alias("p_word"),
    )
    active = cases.select("case_id", "question", "primary_article_id").join(approved.select("case_id"), "case_id", "left_semi")
    active = active.join(own, "primary_article_id")
    terms = _case_terms(cases, active, approved, art)
    top = retrieved.where(F.col("rank") <= 20).select("case_id", "article_id").distinct()
    top = top.join(active.select("case_id"), "case_id", "left_semi")
    known = gold.select("case_id", "article_id").distinct().join(active.select("case_id"), "case_id", "left_semi")
    texts = art.select("article_id", "source_id", "category", F.lower("candidate_title").alias("title"), F.col("candidate_text").alias("body"), "published_at", "created_at")
    rows = mining.best_articles(texts, _packed_cases(active, terms, top, known), n)
    rows = rows.join(art.drop("candidate_text", "source_id", "category"), "article_id")
    rows = rows.join(active.select("case_id", "p_published"), "case_id")
    kind = (
        F.when(F.col("same_source"), "same_source_wrong_article")
        .when(~F.to_date("published_at").eqNullSafe(F.to_date("p_published")), "same_entity_wrong_time")
        .when(F.col("same_category"), "same_topic_wrong_event")
        .otherwise("semantically_similar_not_answer_supporting")
    )
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = rows.withColumn("hard_negative_type", kind).withColumn("away", F.abs(seconds("published_at") - seconds("p_published")))
    order = [
        F.col("appeared_in_top_k").desc(), F.col("strong_entity_tag_shared").desc(), F.col("question_overlap_terms").desc(), F.col("gold_title_overlap_terms").desc(),
        F.col("same_source").desc(), F.col("same_category").desc(), F.col("away").asc_nulls_last(), F.col("created_at").desc(), F.col("article_id"),
    ]
    return top_per(rows, ["case_id"], order, n, "proposal_rank").drop("away", "created_at", "published_at", "p_published")


def _case_terms(cases: DataFrame, active: DataFrame, approved: DataFrame, art: DataFrame) -> DataFrame:
    """(case_id, term, q, g, t): words of the question and of the evidence, and entity tags."""
    flagged = lambda df, q, g, t: df.select("case_id", "term", F.lit(q).alias("q"), F.lit(g).alias("g"), F.lit(t).alias("t"))
    asked = active.select("case_id", F.explode(_words(F.col("question"))).alias("term"))
    evidence = approved.where(~is_hard_negative()).select("case_id", "article_id").join(active.select("case_id"), "case_id", "left_semi")
    evidence = evidence.join(art.select("article_id", "candidate_text"), "article_id")
    every = flagged(asked, 1, 0, 0).unionByName(flagged(evidence.select("case_id", F.explode(_words(F.col("candidate_text"))).alias("term")), 0, 1, 0))
    if "entity_tags" in cases.columns:
        tags = cases.join(active.select("case_id"), "case_id", "left_semi").select("case_id", F.explode("entity_tags").alias("term"))
        tags = tags.where(F.length("term") >= 3).select("case_id", F.lower("term").alias("term"))
        every = every.unionByName(flagged(tags, 0, 0, 1))
    return every.groupBy("case_id", "term").agg(*[F.max(c).alias(c) for c in ("q", "g", "t")])


def _packed_cases(active: DataFrame, terms: DataFrame, top: DataFrame, known: DataFrame) -> DataFrame:
    """One row per case with its terms, retrieved and known articles as lists."""
    lists = terms.groupBy("case_id").agg(F.collect_list(F.struct("term", "q", "g", "t")).alias("terms"))
    seen = top.groupBy("case_id").agg(F.collect_list("article_id").alias("retrieved"))
    judged = known.groupBy("case_id").agg(F.collect_list("article_id").alias("known"))
    rows = active.drop("question").join(lists, "case_id", "left").join(seen, "case_id", "left")
    return rows.join(judged, "case_id", "left")


# ---------------------------------------------------------------- taxonomy

# Patterns of the case taxonomy.
_NAMED = "OpenAI|Anthropic|Google|Microsoft|Okta|xAI"
COMPARES = "(?:compare|versus| vs |比较|对比)"
TIMES = "(?:timeline|when|date|时间|日期|何时)"
FOLLOWS_UP = "(?:these|it|that|上述|这家公司|该公司)"
JOINS = "(?:and|以及|同时|之间|多方|multi-hop)"
LEGAL = "(?:legal|lawsuit|FedRAMP|合规|司法|法院|监管)"


def taxonomy(cases: DataFrame, articles: DataFrame, sources: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Format, length, question type, entity density, origin and tags of every case.

    The name patterns ignore case by default, so nearly every Latin word counts
    as a name; ``case_sensitive=True`` is the useful variant.
    """
    i = "(?u)" if case_sensitive else "(?iu)"
    text = F.coalesce("article_content", "summary_en", "summary_zh", F.lit(""))
    art = articles.select(F.col("id").alias("primary_article_id"), "source_id", F.length(text).alias("article_chars"))
    rows = cases.join(art, "primary_article_id", "left").join(sources.select("source_id", "source_type"), "source_id", "left")
    n = F.coalesce("article_chars", F.lit(0))
    q, kind = F.col("question"), F.col("source_type")
    has = lambda p: q.rlike(f"(?iu){p}")
    name = "[A-Z][A-Za-z0-9$.-]+"
    dense = q.rlike(rf"{i}(?:{name}.*{name}|{_NAMED}|\$[0-9])")
    format_cohort = (
        F.when(kind.isin("youtube", "podcast"), "transcript")
        .when(kind.isin("reddit", "apify_tweet", "x_api"), "reddit_social")
        .when(kind.isin("official_rss", "official_html"), "official")
        .when(n > 1500, "long_form")
        .when(n >= 1, "short_news")
        .otherwise("unknown")
    )
    bucket = F.when(n <= 300, "short_0_300").when(n <= 1500, "medium_301_1500").otherwise("long_1501_plus")
    question_type = (
        F.when((F.col("case_type") == "comparison") | has(COMPARES), "comparison")
        .when((F.col("case_type") == "temporal") | has(TIMES), "timeline")
        .when(has(FOLLOWS_UP), "ambiguous_followup")
        .when(has(JOINS), "multi_hop")
        .when(q.rlike(f"{i}(?:{name}|[0-9]+|{_NAMED})"), "entity_lookup")
        .otherwise("single_hop")
    )
    density = F.when(dense, "high").when(q.rlike(f"{i}(?:{name}|[0-9]+)"), "medium").otherwise("low")
    origin = F.when(F.col("case_source") == "production_badcase", "production_badcase").when(F.col("case_source") == "manual", "human").otherwise("synthetic_paraphrase")
    tags = F.array_compact(
        F.array(
            F.when(dense, F.lit("entity_heavy")),
            F.when(has(TIMES), F.lit("temporal_event")),
            F.when(has(LEGAL), F.lit("legal_policy")),
            F.when(n > 1500, F.lit("long_context")),
            F.when(n <= 300, F.lit("short_sparse")),
        )
    )
    return rows.select(
        "case_id", format_cohort.alias("format_cohort"), bucket.alias("content_length_bucket"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("lang", F.lit("zh")).alias("language"),
        question_type.alias("question_type"), density.alias("entity_density"), origin.alias("origin"), tags.alias("difficulty_tags"),
    )


def missing_taxonomy(cases: DataFrame, tagged: DataFrame) -> DataFrame:
    """Cases without a full set of taxonomy labels."""
    cols = ["format_cohort", "content_length_bucket", "source_type", "question_type", "entity_density", "origin"]
    full = tagged.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    return cases.join(full.select("case_id"), "case_id", "left_anti")


def latest_runs(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest run per strategy."""
    return latest_per(runs, by or ["strategy"], [F.col("created_at").desc(), F.col("run_id").desc()])
