"""Catalog: streaming jobs, run over the stored tables until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.columns import _ROUTE, ai_sql
from newsiq.catalog.relational import VOTES
from newsiq.catalog.sqltext import CANON
from newsiq.catalog.tables import AS_OF, DERIVED, SPARK, BASE
from newsiq.operators.lineage import shared_folder
from newsiq.plans import reports as rp
from newsiq.streaming import jobs
from newsiq.streaming.keyed import KeyedTable


def _derived(t, name: str, raw):
    """A derived table by its SQL over ``raw``, the stream of its one driver table."""
    build = DERIVED[name][1] if name in DERIVED else None
    if build is None:
        return raw
    (base,) = DERIVED[name][0]
    text = build(SPARK).replace("{", "{{").replace("}", "}}")
    assert base in BASE
    return t.spark.sql(text.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: raw})


def _base(name: str) -> str:
    (base,) = DERIVED[name][0] if name in DERIVED else (name,)
    return base


def stream_of(t, name: str):
    """A derived table as a stream: the same SQL over a file stream of its one driver table."""
    base = _base(name)
    return _derived(t, name, jobs.stream_table(t.spark, f"{t.sf_dir}/{base}.parquet", getattr(t, base).schema))


def run_in_batches(t, name: str, batches: int, job, path: str, **how) -> None:
    """Run ``job`` over a derived table whose driver table arrives in so many batches, by ascending id.

    A batch arrives as the files of all the tasks that write it, and is
    processed before the next one comes; the query goes on from its checkpoint.
    """
    table, arrived = getattr(t, _base(name)), folder(t)
    key = table.columns[0]
    lo, hi = table.agg(F.min(key), F.max(key)).first()
    part = F.floor((F.col(key) - lo) * batches / (hi - lo + 1)) if lo is not None else F.lit(0)
    for i in range(batches):
        table.where(part == i).write.mode("append").parquet(arrived)
        rows = _derived(t, name, jobs.stream_table(t.spark, arrived, table.schema))
        jobs.run_available(job(rows), path, **how)


def folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def with_time(df, col: str):
    return df.withColumn(col, F.col(col).cast("timestamp"))


@query("str_1_ingest", f"SELECT min(id) AS id, {CANON('url')} AS url FROM items WHERE {ai_sql('body')} GROUP BY 2", ("items",))
def ingest(t):
    def relevant(items):
        rows = with_time(items, "published_at").withColumnRenamed("body", "raw_content")
        # of the copies of a url within one batch any may be the one kept
        return jobs.ingest(rows.select("id", "url", "raw_content", "published_at"), "60 days", "published_at").select("url")

    path = folder(t)
    run_in_batches(t, "items", 4, relevant, path)
    kept = t.spark.read.schema("url string").parquet(f"{path}/data")
    from newsiq.functions import text as tx

    first = t.items.where(tx.is_ai_relevant("body")).groupBy(tx.canonical_url("url").alias("url")).agg(F.min("id").alias("id"))
    return kept.join(first, "url", "left").select("id", "url")


@query(
    "str_1_insert_new",
    f"SELECT min(id) AS id, {CANON('url')} AS url FROM items GROUP BY 2",
    ("items",),
)
def insert_new(t):
    from newsiq.functions import text as tx

    path = folder(t)
    run_in_batches(t, "items", 4, lambda items: items.select("id", tx.canonical_url("url").alias("url")), path, writer=jobs.insert_new(f"{path}/data", "url", "id"))
    return KeyedTable(t.spark, f"{path}/data", "id long, url string", ["url"]).read()


@query(
    "str_2_route_late",
    """SELECT id, CASE WHEN published_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '9' DAY THEN 'too_old' WHEN url IN (SELECT url FROM raw WHERE status = 'done') THEN 'known_url' ELSE 'kept' END AS outcome FROM news""",
    ("news", "raw"),
)
def route_late(t):
    path = folder(t)
    writer = jobs.route_late(f"{path}/new", f"{path}/late", t.raw.where("status = 'done'").select("url"), AS_OF, days=10)
    run_in_batches(t, "news", 4, lambda news: news.select("id", "url", "published_at"), path, writer=writer)
    kept = t.spark.read.parquet(f"{path}/new").select("id", F.lit("kept").alias("outcome"))
    return kept.unionByName(t.spark.read.parquet(f"{path}/late").select("id", F.col("reason").alias("outcome")))


@query(
    "str_3_enrich",
    f"""SELECT id, source_type, CASE WHEN err IS NULL THEN 'done' WHEN err LIKE 'Validation%' THEN 'retry' ELSE 'error' END AS status, err AS last_error FROM (
      SELECT r.id, s.source_type, CASE WHEN r.id % 11 = 0 THEN 'empty raw_content' WHEN r.id % 6 = 0 AND NOT {ai_sql('r.raw_content')} THEN 'NOT_AI_RELEVANT' WHEN sentinel IS NOT NULL THEN sentinel
        WHEN summary_en = '' THEN 'Validation Error: Empty summary field' END AS err FROM ({_ROUTE.replace('SELECT id,', 'SELECT id, source_id,', 1)}) r JOIN sources s USING (source_id)) y""",
    ("news", "sources"),
)
def enrich(t):
    def outcomes(news):
        rows = t.spark.sql(_ROUTE.replace("SELECT id,", "SELECT id, source_id,", 1).replace("FROM news", "FROM {news}"), news=news)
        return jobs.enrich(rows, t.sources).select("id", "source_type", "status", "last_error")

    path = folder(t)
    run_in_batches(t, "news", 4, outcomes, path)
    return t.spark.read.schema("id long, source_type string, status string, last_error string").parquet(f"{path}/data")


@query(
    "str_4_freshness",
    """SELECT source_id, window_start, count(*) AS raw_rows, max(fetched_at) AS newest_raw_row_at FROM (SELECT source_id, fetched_at, date_trunc('hour', fetched_at) - INTERVAL '1' HOUR * unnest(generate_series(0, 23)) AS window_start FROM raw) x GROUP BY 1, 2""",
    ("raw",),
)
def freshness(t):
    path = folder(t)
    jobs.run_available(jobs.freshness(with_time(stream_of(t, "raw").select("source_id", "fetched_at"), "fetched_at")), path, "complete")
    out = t.spark.read.schema("source_id long, window_start timestamp, raw_rows long, newest_raw_row_at timestamp").parquet(f"{path}/data")
    return out.select("source_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "raw_rows", F.col("newest_raw_row_at").cast("timestamp_ntz").alias("newest_raw_row_at"))


@query(
    "str_5_canary",
    """SELECT date_trunc('day', r.created_at) AS window_start, strategy, count(*) AS requests, quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
      round(avg(CASE WHEN injected_count = 0 THEN 1 ELSE 0 END), 6) AS empty_candidate_rate, round(avg(CASE WHEN q.error_message IS NOT NULL THEN 1 ELSE 0 END), 6) AS qa_error_rate,
      round(coalesce(avg(CASE WHEN q.feedback < 0 THEN 1 WHEN q.feedback IS NOT NULL THEN 0 END), 0), 6) AS negative_feedback_rate,
      round(avg(CASE WHEN json_extract_string(query_input, '$.fallback_reason') = 'chunk_dense_failed_fell_back_to_article_dense' THEN 1 ELSE 0 END), 6) AS fallback_rate
      FROM runs r LEFT JOIN qa_logs q ON q.qa_log_id = r.qa_log_id WHERE surface = 'answer_question_related_articles' GROUP BY 1, 2""",
    ("runs", "qa_logs"),
)
def canary(t):
    path = folder(t)
    logs = t.qa_logs.select("qa_log_id", "error_message", "feedback")
    run_in_batches(t, "runs", 4, lambda runs: jobs.canary(with_time(runs, "created_at").join(logs, "qa_log_id", "left")), path, mode="complete")
    out = t.spark.read.parquet(f"{path}/data")
    rates = ("empty_candidate_rate", "qa_error_rate", "negative_feedback_rate", "fallback_rate")
    return out.select(
        F.date_trunc("day", F.col("window_start").cast("timestamp_ntz")).cast("timestamp_ntz").alias("window_start"), "strategy", "requests",
        "p50_latency_ms", "p95_latency_ms", *[F.round(c, 6).alias(c) for c in rates],
    )


# recursive SQL finds the request that opens each next window of a user
LIMITER = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  nx AS MATERIALIZED (SELECT a.user_id, a.n, min(b.n) AS nxt FROM e a JOIN e b ON b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL '6' HOUR GROUP BY 1, 2),
  opens AS (SELECT user_id, n FROM e WHERE n = 1 UNION ALL SELECT o.user_id, x.nxt FROM opens o JOIN nx x ON x.user_id = o.user_id AND x.n = o.n),
  f AS (SELECT e.user_id, e.event_id, e.n - max(o.n) + 1 AS request_count FROM e JOIN opens o ON o.user_id = e.user_id AND o.n <= e.n GROUP BY e.user_id, e.event_id, e.n)
  SELECT user_id AS key, event_id, request_count, request_count <= 2 AS allowed FROM f"""


def requests(df):
    return df.select(F.col("user_id").alias("key"), "event_id", "ts")


@query("str_6_rate_limit", LIMITER)
def rate_limit(t):
    path = folder(t)
    jobs.run_available(jobs.rate_limit(requests(stream_of(t, "events")), 2, 6 * 3600), path)
    out = t.spark.read.schema(jobs._LIMIT_OUT).parquet(f"{path}/data")
    return out.select("key", "event_id", "request_count", "allowed")


@query("str_6_rate_limit_batch", LIMITER)
def rate_limit_batch(t):
    return jobs.rate_limit_batch(requests(t.events), 2, 6 * 3600).select("key", "event_id", "request_count", "allowed")


@query("str_7_feedback", VOTES, ("votes",))
def feedback(t):
    path = folder(t)
    run_in_batches(t, "votes", 4, lambda votes: votes, path, writer=jobs.feedback(path))
    return rp.feedback_counts(jobs.vote_table(t.spark, path, t.votes.schema).read())


@query("udx_3_counters", VOTES, ("votes",))
def counters(t):
    """The counters kept from the changes of four batches."""
    path = folder(t)
    run_in_batches(t, "votes", 4, lambda votes: votes, path, writer=jobs.feedback(path))
    return jobs.counter_table(t.spark, path).read()


_GAP = """SELECT source_id, silent_since, silent_since + INTERVAL '10' HOUR AS noticed_at FROM (SELECT source_id, fetched_at AS silent_since, lead(fetched_at) OVER (PARTITION BY source_id ORDER BY fetched_at) AS nxt FROM raw) g"""


@query("str_8_silence", _GAP + " WHERE coalesce(nxt, TIMESTAMP '2024-01-31 00:00:00') > silent_since + INTERVAL '10' HOUR", ("raw",))
def silence(t):
    """Items in the order of their arrival, four batches of them; a last row, of no source, moves the clock to the end."""
    path, rows = folder(t), with_time(t.raw.select("source_id", "fetched_at"), "fetched_at")
    lo, hi = rows.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    part = F.floor((F.unix_seconds("fetched_at") - F.unix_seconds(F.lit(lo))) * 4 / (F.unix_seconds(F.lit(hi)) - F.unix_seconds(F.lit(lo)) + 1))
    end = t.spark.sql(f"SELECT -1L AS source_id, TIMESTAMP '{AS_OF}' + INTERVAL '1' HOUR AS fetched_at")
    for batch in [*(rows.where(part == i) for i in range(4)), end]:
        batch.write.mode("append").parquet(f"{path}/in")
        raw = jobs.stream_table(t.spark, f"{path}/in", rows.schema)
        jobs.run_available(jobs.silence(raw, hours=10, watermark="1 hour"), path)
    out = t.spark.read.schema(jobs._SILENCE_OUT).parquet(f"{path}/data").where("source_id >= 0")
    return out.select("source_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("silent_since", "noticed_at")])


@query("str_8_silence_batch", _GAP + " WHERE coalesce(nxt, TIMESTAMP '2024-01-31 00:00:00') > silent_since + INTERVAL '10' HOUR", ("raw",))
def silence_batch(t):
    return jobs.silence_batch(t.raw, AS_OF, hours=10)
