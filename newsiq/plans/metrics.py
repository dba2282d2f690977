"""Retrieval metrics against graded evidence, for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions.stats import ordered_list
from newsiq.operators.quantiles import quantiles
from newsiq.operators.windows import latest_per, ranked, top_per

RELEVANT = 2


def is_hard_negative(role: Column | str = "evidence_role") -> Column:
    role = F.col(role) if isinstance(role, str) else role
    return F.coalesce(role == "hard_negative", F.lit(False))


def dedupe_articles(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First occurrence of each article per list, re-ranked; rows without an article are skipped."""
    keys = keys or ["query_id"]
    rows = candidates.where(F.col("article_id").isNotNull())
    first = latest_per(rows, [*keys, "article_id"], [F.col("rank")])
    return ranked(first.withColumnRenamed("rank", "_old"), keys, [F.col("_old")]).drop("_old")


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def per_case(candidates: DataFrame, gold: DataFrame, keys: list[str] | None = None, gold_key: str = "query_id") -> DataFrame:
    """recall@3/5/10, mrr, ndcg@10 and hit@5 per case.

    ``keys`` identify a candidate list (for instance strategy and query_id);
    ``gold`` is joined on ``gold_key``.  Recall is 0 without relevant gold.
    Relevant is grade 2 or more; hard negatives never count, and the ideal
    ranking holds all other graded evidence.  Cases come from the gold table.
    """
    keys = keys or [gold_key]
    extra = [k for k in keys if k != gold_key]
    graded = gold.select(
        gold_key, "article_id",
        F.when(is_hard_negative(), 0).otherwise(F.coalesce(F.col("relevance_grade"), F.lit(0))).cast("double").alias("grade"),
        is_hard_negative().alias("hard"),
    )
    useful = graded.where(~F.col("hard") & (F.col("grade") > 0))
    top = top_per(useful, [gold_key], [F.col("grade").desc(), F.col("article_id")], 10, "r")
    ideal = top.groupBy(gold_key).agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))
    relevant = useful.groupBy(gold_key).agg(F.countDistinct(F.when(F.col("grade") >= RELEVANT, F.col("article_id"))).alias("relevant"))
    ideal = ideal.join(relevant, gold_key)
    found = dedupe_articles(candidates, keys).select(*keys, "article_id", "rank").join(graded, [gold_key, "article_id"], "left")
    rel = F.coalesce((F.col("grade") >= RELEVANT) & ~F.col("hard"), F.lit(False))
    hits = lambda k: F.count_if(rel & (F.col("rank") <= k))
    got = found.groupBy(*keys).agg(
        hits(3).alias("h3"), hits(5).alias("h5"), hits(10).alias("h10"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, gain(F.coalesce("grade", F.lit(0.0)), F.col("rank")))).alias("dcg"),
    )
    cases = gold.select(gold_key).distinct()
    if extra:
        # every list is scored on every case it has candidates for
        base = got.join(cases, gold_key, "left_semi").join(ideal, gold_key, "left")
    else:
        base = cases.join(got, gold_key, "left").join(ideal, gold_key, "left")
    n = F.coalesce(F.col("relevant"), F.lit(0))
    recall = lambda c: F.when(n > 0, F.coalesce(F.col(c), F.lit(0)) / n).otherwise(F.lit(0.0))
    return base.select(
        *keys,
        recall("h3").alias("recall_at_3"), recall("h5").alias("recall_at_5"), recall("h10").alias("recall_at_10"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg_at_10"),
        F.coalesce(F.col("h5") > 0, F.lit(False)).alias("hit_at_5"),
    )


METRICS = ("recall_at_3", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")


def aggregate(case_results: DataFrame, by: list[str] | None = None, latencies: DataFrame | None = None) -> DataFrame:
    """Averages, hit rate and case count per run; with ``latencies`` also nearest-rank p50 and p95."""
    by = by or []
    out = case_results.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        *[F.avg(m).alias(f"avg_{m}") for m in METRICS],
        F.avg(F.col("hit_at_5").cast("double")).alias("avg_hit_rate_at_5"),
    )
    if latencies is not None:
        lat = quantiles(latencies, by, {"latency_p50_ms": ("latency_ms", 0.5, "disc"), "latency_p95_ms": ("latency_ms", 0.95, "disc")})
        if by:
            return out.join(lat, by, "left")
        out = out.select("*", *[lat.select(c).scalar().alias(c) for c in lat.columns])
    return out


def hard_negatives(candidates: DataFrame, gold: DataFrame, key: str = "query_id") -> DataFrame:
    """Hard negatives ranked above the best relevant article, per case.

    An article listed twice counts with its best rank.  Without any retrieved
    relevant article nothing counts as above it.
    """
    marks = gold.select(
        key, "article_id", is_hard_negative().alias("hard"), (~is_hard_negative() & (F.col("relevance_grade") >= RELEVANT)).alias("rel")
    )
    best = candidates.groupBy(key, "article_id").agg(F.min("rank").alias("rank"))
    found = marks.join(best, [key, "article_id"], "left")
    tops = found.groupBy(key).agg(
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("best_gold_rank"),
        F.min(F.when(F.col("hard"), F.col("rank"))).alias("best_hard_negative_rank"),
    )
    above = found.where("hard").join(tops.select(key, "best_gold_rank"), key).where(F.col("rank") < F.col("best_gold_rank"))
    listed = above.groupBy(key).agg(
        F.count("*").alias("n"), F.array_join(ordered_list(F.col("article_id").cast("string"), "rank", "article_id"), ",").alias("ids")
    )
    return tops.join(listed, key, "left").select(
        key,
        F.coalesce("n", F.lit(0)).alias("hard_negatives_above_gold"),
        "best_gold_rank",
        "best_hard_negative_rank",
        F.coalesce("ids", F.lit("")).alias("hard_negative_article_ids_above_gold"),
    )
