"""Ranked retrieval over whole question tables.

Candidate tables have one row per (query_id, article_id) and a ``rank``; the
rankers below take and return such tables.  Per-query groups never exceed the
requested ``k`` times a constant, so windows by query stay small however large
the corpus is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsiq.functions import text as tx
from newsiq.functions.stats import ordered_list
from newsiq.operators import questions as qs
from newsiq.operators.knn import knn_join
from newsiq.operators.termindex import best_matches
from newsiq.operators.windows import latest_per, ranked, top_per

TITLE_FIELDS = ("title", "title_en", "title_zh")
SUMMARY_FIELDS = ("summary", "summary_en", "summary_zh")
RANK_DIGITS = 9


def dense(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "article_id", vec: str = "embedding") -> DataFrame:
    """Nearest ``k`` articles of every query by cosine similarity."""
    return knn_join(queries, corpus, k, id_col=id_col, vec=vec)


def prefer_analysis(queries: DataFrame, articles: DataFrame, analysis: DataFrame, k: int) -> DataFrame:
    """Top-k over ready analysis vectors and articles without one, labelled by provenance.

    Each branch is cut to ``k`` before the union, so the merge sees at most 2k
    rows per query.
    """
    ready = analysis.where((F.col("status") == "ready") & F.col("embedding").isNotNull())
    rest = articles.join(ready.select("article_id"), "article_id", "left_anti")
    a = dense(queries, ready, k).withColumn("embedding_source", F.lit("deep_analysis"))
    b = dense(queries, rest, k).withColumn("embedding_source", F.lit("daily_news"))
    both = a.unionByName(b).drop("rank")
    order = [F.col("score").desc(), F.col("article_id"), F.col("embedding_source")]
    return top_per(both, ["query_id"], order, max(k, 1), "rank")


def chunk_dense(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    m: int = 5,
    version: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """Chunk search: overfetch, best chunk per article, articles re-ranked, cut to ``k``.

    The overfetch is ``max(k*max(m,1), k, 1)`` chunks, so fewer than ``k``
    articles may come back.
    """
    kept = chunks
    if model is not None:
        kept = kept.where(F.col("embedding_model") == model)
    if version is not None:
        kept = kept.where(F.col("chunking_version") == version)
    hits = knn_join(queries, kept, max(k * max(m, 1), k, 1), id_col="chunk_id", carry=["article_id", "chunk_index"])
    hits = hits.withColumnRenamed("rank", "chunk_rank")
    best = latest_per(hits, ["query_id", "article_id"], [F.col("score").desc(), F.col("chunk_rank")])
    return top_per(best, ["query_id"], [F.col("score").desc(), F.col("chunk_rank")], max(k, 1), "article_rank")


# ---------------------------------------------------------------- lexical


def term_table(queries: DataFrame, question: str = "question") -> DataFrame:
    """(query_id, term) of every question, terms as the search uses them."""
    terms = queries.select("query_id", F.explode(qs.lexical_terms(question)).alias("term"))
    return terms.select("query_id", F.lower(F.trim("term")).alias("term")).where(F.length("term") >= 2)


def lexical(queries: DataFrame, articles: DataFrame, k: int, id_col: str = "article_id", terms: DataFrame | None = None, partitions: int | None = None, plain: bool = False) -> DataFrame:
    """Substring search scored by trigram similarity, best ``k`` articles per query.

    An article qualifies for a term when one of its title or summary fields
    contains it; the term adds the greatest of 4 x title similarity and
    2 x summary similarity.  ``terms`` overrides the question's own terms;
    ``plain`` says that they, too, consist of letters and digits.
    ``partitions`` spreads a table that is stored in few blocks.
    """
    plain = plain or terms is None  # a question's own terms are letters and digits
    terms = (term_table(queries) if terms is None else terms).dropDuplicates(["query_id", "term"])
    weights = {f: 4.0 for f in TITLE_FIELDS} | {f: 2.0 for f in SUMMARY_FIELDS}
    return best_matches(articles, terms, id_col, weights, max(k, 1), RANK_DIGITS, partitions, plain)


# ---------------------------------------------------------------- fusion


def _tagged(lists: list[DataFrame], id_col: str) -> DataFrame:
    parts = []
    for i, df in enumerate(lists):
        source = F.col("source_key") if "source_key" in df.columns else F.lit(f"list{i}")
        parts.append(
            df.select(
                "query_id", id_col, F.coalesce(F.col("rank"), F.lit(1)).alias("rank"), source.alias("source_key"),
                F.lit(i).alias("list_no"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def weighted_rrf(
    lists: list[DataFrame], weights: dict[str, float] | None = None, k: int = 50, id_col: str = "article_id"
) -> DataFrame:
    """Reciprocal-rank fusion with one weight per ``source_key`` (default 1).

    Equal scores keep first-seen order: earlier list, then better rank.
    """
    rows = _tagged(lists, id_col)
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.element_at(table, F.col("source_key")), F.lit(1.0))
    fused = rows.groupBy("query_id", id_col).agg(
        F.round(F.sum(weight / (F.lit(float(k)) + F.col("rank"))), 12).alias("score_final"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
        F.array_join(ordered_list("source_key", "list_no", "rank"), ",").alias("fusion_sources"),
    )
    order = [F.col("score_final").desc(), F.col("_first.list_no"), F.col("_first.rank"), F.col(id_col)]
    return ranked(fused, ["query_id"], order).drop("_first")


def rrf(lists: list[DataFrame], k: int = 60, id_col: str = "article_id") -> DataFrame:
    """Unweighted reciprocal-rank fusion; a missing rank counts as 1."""
    return weighted_rrf(lists, None, k, id_col)


def merge_best(lists: list[DataFrame], id_cols: list[str], score: str = "score_final") -> DataFrame:
    """Union keeping the best score per id, re-ranked; equal scores keep the first seen."""
    rows = reduce(
        DataFrame.unionByName,
        [d.select("query_id", *id_cols, "rank", score, F.lit(i).alias("list_no")) for i, d in enumerate(lists)],
    )
    # the first of the best rows stays, but an id keeps the place where it was first seen
    best = rows.groupBy("query_id", *id_cols).agg(
        F.max(score).alias(score), F.min(F.struct("list_no", "rank")).alias("_first")
    )
    order = [F.col(score).desc(), F.col("_first.list_no"), F.col("_first.rank"), *[F.col(c) for c in id_cols]]
    return ranked(best, ["query_id"], order).drop("_first")


# ---------------------------------------------------------------- rerank


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by an external score table (query_id, index, score).

    Position ``i`` (from 0) takes the score of index ``i``, else of ``i + 1``,
    else 0; equal scores keep their previous order.
    """
    s = latest_per(scores.where(F.col("score").isNotNull()), ["query_id", "index"], [F.col("score").desc()])
    s = s.select("query_id", "index", "score")
    at = candidates.withColumn("_i", (F.col("rank") - 1).cast("long"))
    same = s.select("query_id", F.col("index").cast("long").alias("_i"), F.col("score").alias("_s0"))
    after = s.select("query_id", (F.col("index") - 1).cast("long").alias("_i"), F.col("score").alias("_s1"))
    out = at.join(same, ["query_id", "_i"], "left").join(after, ["query_id", "_i"], "left")
    out = out.withColumn("score_rerank", F.coalesce("_s0", "_s1", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.col("score_rerank").desc(), F.col("rank"))
    return out.withColumn("new_rank", F.row_number().over(w)).select(
        *[c for c in candidates.columns if c not in ("rank", "score_final")],
        F.col("rank").alias("previous_rank"),
        F.col("new_rank").alias("rank"),
        "score_rerank",
        F.col("score_rerank").alias("score_final"),
    )


def rerank_by_judge(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Judge scores of 0..100 for positions from 1; unscored rows keep their final score."""
    s = scores.select("query_id", F.col("index").cast("int").alias("rank"), F.col("score").alias("_s"))
    out = candidates.join(s, ["query_id", "rank"], "left")
    out = out.withColumn("score_rerank", F.coalesce(F.col("_s") / 100, F.lit(0.0)))
    out = out.withColumn("_f", F.coalesce(F.col("_s") / 100, F.col("score_final"), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.col("_f").desc(), F.col("rank"))
    return out.withColumn("_n", F.row_number().over(w)).select(
        *[c for c in candidates.columns if c not in ("rank", "score_final")],
        F.col("_n").alias("rank"), "score_rerank", F.col("_f").alias("score_final"),
    )


def normalized_query(x: Column | str) -> Column:
    return F.lower(tx.squeeze(x))


def with_cache_key(
    candidates: DataFrame, model: str, version: str | None = None, variant: str = "rerank_hybrid", text: str = "context"
) -> DataFrame:
    """Candidates with the ``cache_key`` of their list.

    The key hashes query, ordered ids and context hashes.  ``candidates`` holds
    one ranked list per query (query_id, question, article_id, rank and a text
    column); a list is no longer than the retrieval asked for.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # fixed values: version and field names of the key, in the order in which they are hashed
    payload = F.to_json(
        F.struct(
            F.lit("rag-rerank-cache-v1").alias("cache_version"),
            normalized_query("question").alias("normalized_query"),
            F.collect_list(F.col("article_id").cast("string")).over(w).alias("ordered_candidate_ids"),
            F.collect_list(F.sha2(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 4000), 256)).over(w).alias("context_hashes"),
            F.lit(model).alias("rerank_model"),
            F.lit(version).cast("string").alias("chunking_version"),
            F.lit(variant).alias("strategy_variant"),
        ),
        {"ignoreNullFields": "false"},
    )
    return candidates.withColumn("cache_key", F.sha2(payload, 256))


def cache_keys(candidates: DataFrame, model: str, **key_args) -> DataFrame:
    """(query_id, cache_key) of every ranked list."""
    keyed = with_cache_key(candidates, model, **key_args).where(F.col("rank") == 1)
    return keyed.select("query_id", "cache_key")


def cache_lookup(candidates: DataFrame, cache: DataFrame, model: str, **key_args) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): hits ordered by the cached scores, misses to be scored.

    ``cache`` has one row per (cache_key, article_id) with ``score_rerank`` and
    ``stale_reason``; only rows that are not stale count.
    """
    keyed = with_cache_key(candidates, model, **key_args)
    fresh = cache.where(F.col("stale_reason").isNull())
    misses = keyed.join(fresh.select("cache_key"), "cache_key", "left_anti")
    # the cached list and the candidate list of one key hold the same ids
    scores = fresh.groupBy("cache_key", "article_id").agg(F.max("score_rerank").alias("score_rerank"))
    hits = keyed.join(scores, ["cache_key", "article_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("score_rerank").desc(), F.col("rank"))
    hits = hits.withColumn("previous_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))
    return hits, misses


# ---------------------------------------------------------------- strategies

# Names of the strategies and their aliases.
STRATEGIES = ("dense", "lexical", "hybrid", "chunk_dense", "chunk_hybrid", "entity_hybrid", "rerank_hybrid")
ALIASES = {"article_dense": "dense", "entity_expanded_chunk": "entity_hybrid"}


def run(
    strategy: str,
    queries: DataFrame,
    k: int,
    chunks: DataFrame | None = None,
    articles: DataFrame | None = None,
    article_vectors: DataFrame | None = None,
    analysis_vectors: DataFrame | None = None,
    scores: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    model: str | None = None,
    version: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Candidates (query_id, article_id, rank, score_final) of one named strategy.

    ``queries`` has query_id, question and query_embedding.  Mixed strategies
    overfetch ``max(3k, 30)`` per list before fusing.  ``partitions`` spreads
    the articles of a lexical list, see :func:`lexical`.
    """
    strategy = ALIASES.get(strategy, strategy)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    over = max(3 * k, 30)
    out = ["query_id", "article_id", "rank", "score_final"]

    def chunk_list(n: int, key: str) -> DataFrame:
        hits = chunk_dense(queries, chunks, n, 5, version, model)
        return hits.select(
            "query_id", "article_id", F.col("article_rank").alias("rank"), F.col("score").alias("score_final"),
            F.lit(key).alias("source_key"),
        )

    def lexical_list(n: int, terms: DataFrame | None = None) -> DataFrame:
        hits = lexical(queries, articles, n, terms=terms, partitions=partitions, plain=True)  # terms of questions
        return hits.select("query_id", "article_id", "rank", F.col("score").alias("score_final"), F.lit("lexical").alias("source_key"))

    def dense_list() -> DataFrame:
        hits = prefer_analysis(queries, article_vectors, analysis_vectors, k)
        return hits.select(
            "query_id", "article_id", "rank", F.col("score").alias("score_final"), F.col("embedding_source").alias("source_key")
        )

    if strategy == "lexical":
        return lexical_list(k).select(*out)
    if strategy == "dense":
        return dense_list().select(*out)
    if strategy == "chunk_dense":
        return chunk_list(k, "chunk").select(*out)
    if strategy == "hybrid":
        fused = rrf([dense_list(), lexical_list(k)])
    elif strategy == "chunk_hybrid":
        fused = weighted_rrf([chunk_list(over, "vector"), lexical_list(over)], weights, 50)
    elif strategy == "entity_hybrid":
        expanded = qs.expanded_queries("question")
        second = F.coalesce(F.get(expanded, F.lit(1)), F.get(expanded, F.lit(0)))
        terms = term_table(queries.select("query_id", second.alias("question")))
        fused = weighted_rrf([chunk_list(over, "vector"), lexical_list(over, terms)], weights, 50)
    else:
        fused = rrf([chunk_list(over, "chunk"), lexical_list(over)]).where(F.col("rank") <= over)
        fused = rerank(fused, scores)
    return fused.where(F.col("rank") <= k).select(*out)


def two_rounds(plans: DataFrame, retriever, id_cols: tuple[str, ...] = ("article_id", "chunk_id")) -> DataFrame:
    """Plan-driven retrieval with at most two rounds.

    ``plans`` has one row per (plan_id, subquery_id) with intent and query;
    ``retriever(df, round)`` returns (plan_id, subquery_id, ids, score_final).
    Round two runs only for plans whose first round was not sufficient.  The
    result has one row per plan with its counts and stop reason.
    """
    linear = F.col("intent") == "simple"
    active = plans.where(~linear | (F.col("subquery_id") == "sq1"))

    def found(df: DataFrame) -> DataFrame:
        return df.select("plan_id", *id_cols).distinct()

    first = found(retriever(active, 1))
    per_plan = plans.groupBy("plan_id").agg(
        F.first("intent").alias("intent"), F.count("*").alias("subqueries")
    )
    state = per_plan.join(first.groupBy("plan_id").agg(F.count("*").alias("n1")), "plan_id", "left").fillna(0, ["n1"])
    enough = (F.col("n1") > 0) & ~((F.col("intent") == "comparison") & (F.col("n1") < 2))
    state = state.withColumn("retry", ~linear & ~enough)
    again = active.join(state.where("retry").select("plan_id"), "plan_id", "left_semi")
    second = found(retriever(again, 2)).join(state.where("retry").select("plan_id"), "plan_id", "left_semi")
    total = first.unionByName(second).distinct().groupBy("plan_id").agg(F.count("*").alias("candidates"))
    out = state.join(total, "plan_id", "left").fillna(0, ["candidates"])
    ok = F.col("candidates") > 0
    reason = (
        F.when(linear, "linear_simple_question")
        .when(F.col("retry") & ok, "critique_retry_satisfied")
        .when(~F.col("retry") & ok, "critique_sufficient")
        .otherwise("max_rounds_reached")
    )
    return out.select(
        "plan_id",
        "intent",
        F.when(linear, "linear_fallback").otherwise("agentic").alias("mode"),
        F.when(linear, F.lit(1)).otherwise(F.least(F.col("subqueries"), F.lit(3))).cast("long").alias("subquery_count"),
        F.when(F.col("retry"), 2).otherwise(1).cast("long").alias("retrieval_rounds"),
        F.col("candidates").cast("long").alias("candidate_count"),
        ok.alias("answerable"),
        reason.alias("stop_reason"),
    )
