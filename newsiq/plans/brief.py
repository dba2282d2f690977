"""Trend briefs: article selection per window, history, sources, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx
from newsiq.functions.stats import ordered_list
from newsiq.operators.context import history_disposition
from newsiq.operators.knn import knn_join
from newsiq.operators.windows import latest_per, top_per
from newsiq.plans.enrich import engagement_score

SELECTED, HISTORY_POOL, HISTORY_CAP = 12, 15, 8
FOREVER = "9999-12-31 00:00:00"


def effective(published: str = "published_at", created: str = "created_at") -> Column:
    return F.coalesce(published, created)


def select(news: DataFrame, windows: DataFrame, n: int = SELECTED) -> DataFrame:
    """Top ``n`` articles of every (anchor_date, step_days) window by engagement, then recency.

    Windows are made of whole days, so an article outside the best ``n`` of its
    own day is in no window's best ``n``; only those few rows per day are
    matched with windows, whose number per article is at most the longest step.
    """
    order = [F.col("engagement").desc(), F.col("at").desc(), F.col("id")]
    rows = news.withColumn("engagement", engagement_score("likes", "score").cast("long")).withColumn("at", effective())
    rows = rows.withColumn("day", F.to_date("at"))
    best = top_per(rows, ["day"], order, n)
    longest = windows.select(F.max("step_days").cast("int")).scalar()
    spans = best.withColumn("offset", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(longest, F.lit(1)) - 1, F.lit(0)))))
    spans = spans.withColumn("anchor_date", F.date_add("day", F.col("offset")))
    hits = spans.join(windows.select("anchor_date", "step_days").distinct(), "anchor_date").where(F.col("offset") < F.col("step_days"))
    return top_per(hits.drop("offset"), ["anchor_date", "step_days"], order, n, "rank").drop("day")


def history(selected: DataFrame, vectors: DataFrame, news: DataFrame, k: int = HISTORY_POOL, cap: int = HISTORY_CAP) -> DataFrame:
    """Candidates of historical context per window with their disposition.

    The seed is the window's first article; its ``k`` nearest are looked at in
    order, selected ones and ones inside the window are skipped, and ``cap`` are
    taken.
    """
    key = (F.datediff("anchor_date", F.lit("1970-01-01").cast("date")) * 1000 + F.col("step_days")).cast("long")
    picked = selected.withColumn("query_id", key)
    seeds = picked.where(F.col("rank") == 1).select("query_id", "anchor_date", "step_days", F.col("id").alias("seed_id"))
    queries = seeds.join(vectors.select(F.col("article_id").alias("seed_id"), F.col("embedding").alias("query_embedding")), "seed_id")
    found = knn_join(queries, vectors, k, id_col="article_id")
    found = found.join(seeds, "query_id").join(
        news.select(F.col("id").alias("article_id"), effective().alias("at")), "article_id"
    )
    mine = picked.select("query_id", F.col("id").alias("article_id"), F.lit(True).alias("selected"))
    found = found.join(mine, ["query_id", "article_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    day = F.to_date("at")
    inside = (day > F.date_sub("anchor_date", F.col("step_days").cast("int"))) & (day <= F.col("anchor_date"))
    return history_disposition(found.withColumn("in_window", inside), cap)


def _label(at: Column) -> Column:
    return F.date_format(at, "MMM d")


def sources(selected: DataFrame, hist: DataFrame, news: DataFrame) -> DataFrame:
    """Numbered source rows of every window: selected first, then the taken history."""
    a = selected.select("anchor_date", "step_days", F.col("rank").cast("long").alias("n"), "id", F.lit(False).alias("is_historical"))
    taken = hist.where("injected").select("anchor_date", "step_days", F.col("rank").cast("long").alias("n"), F.col("article_id").alias("id"), F.lit(True).alias("is_historical"))
    both = a.unionByName(taken)
    ranked = top_per(both, ["anchor_date", "step_days"], [F.col("is_historical"), F.col("n")], SELECTED + HISTORY_CAP, "index")
    info = news.select("id", "title", "url", effective().alias("at"), "summary_en", "summary_zh")
    out = ranked.join(info, "id").withColumn("url", F.when(~F.col("is_historical"), F.col("url")))
    return out.withColumn("index", F.col("index").cast("long")).drop("n")


def blocks(source_rows: DataFrame, lang: str) -> DataFrame:
    """Prompt block per window: numbered lines with title, date and bullets, history apart."""
    line = F.concat(
        F.lit("["), F.col("index").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" | "), _label(F.col("at")), F.lit(" | "),
        tx.bullets(f"summary_{lang}"),
    )
    part = lambda flag: F.array_join(ordered_list(line, "index", where=F.col("is_historical") == flag), "\n")
    rows = source_rows.groupBy("anchor_date", "step_days").agg(part(False).alias("current"), part(True).alias("past"))
    past = F.when(F.col("past") != "", F.concat(F.lit("\n\nHistorical context:\n"), F.col("past"))).otherwise("")
    return rows.select("anchor_date", "step_days", F.concat("current", past).alias("block"))


def window_label(anchor: Column | str, step: Column | str) -> Column:
    """Date of a one-day window, else first day to the day after the last."""
    anchor, step = tx._c(anchor), tx._c(step)
    start = F.date_sub(anchor, (step - 1).cast("int"))
    return F.when(step == 1, _label(start)).otherwise(F.concat(_label(start), F.lit(" – "), _label(F.date_add(anchor, 1))))


def expiry(anchor: Column | str, now: str) -> Column:
    """Past windows never expire; the current one after six hours."""
    at = F.lit(now).cast("timestamp_ntz")
    return F.when(tx._c(anchor) < F.to_date(at), F.lit(FOREVER).cast("timestamp_ntz")).otherwise(at + F.expr("INTERVAL 6 HOURS"))


def resolve_cache(requests: DataFrame, user_briefs: DataFrame, briefs: DataFrame, as_of: str, lang: str = "en") -> DataFrame:
    """Cached brief per request: the user's newest unexpired one, else the shared one.

    The newest unexpired row decides; if it lacks the language the next level
    is tried, not an older row.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    col = f"synthesis_{lang}"
    newest = lambda df, keys: latest_per(df.where(F.col("expires_at") > now), keys, [F.col("generated_at").desc(), F.col("brief_id").desc()])
    window = ["anchor_date", "step_days"]
    mine = newest(user_briefs, ["user_id", *window]).select("user_id", *window, F.col(col).alias("own"), F.col("brief_id").alias("own_id"))
    shared = newest(briefs, window).select(*window, F.col(col).alias("all"), F.col("brief_id").alias("all_id"))
    out = requests.join(mine, ["user_id", *window], "left").join(shared, window, "left")
    own, every = F.coalesce("own", F.lit("")) != "", F.coalesce("all", F.lit("")) != ""
    level = F.when(own, "user").when(every, "shared").otherwise("miss")
    return out.select(
        *requests.columns, level.alias("cache"), F.when(own, F.col("own")).when(every, F.col("all")).alias("synthesis"),
        F.when(own, F.col("own_id")).when(every, F.col("all_id")).alias("brief_id"),
    )


def newest_daily(briefs: DataFrame) -> DataFrame:
    """The daily brief a chat request shows."""
    return briefs.where(F.col("step_days") == 1).orderBy(F.col("generated_at").desc(), F.col("brief_id").desc()).limit(1)
