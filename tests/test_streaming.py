"""Streams fed file by file give the batch results."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsiq.catalog import stateful
from newsiq.catalog.tables import Tables
from newsiq.functions import text as tx
from newsiq.plans import reports
from newsiq.streaming import jobs
from newsiq.streaming.keyed import KeyedTable

START = dt.datetime(2024, 1, 1)


def write_files(spark, df, path, parts, key):
    """One file per part, in the order of ``key``, so that parts arrive as micro-batches."""
    pdf = df.toPandas().sort_values(key)
    step = -(-len(pdf) // parts)
    for i in range(parts):
        spark.createDataFrame(pdf.iloc[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def events(spark, n=400, users=5):
    rnd = random.Random(2)
    t, rows = START, []
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([1, 20, 300]))
        # one user sends a third of all requests
        rows.append((0 if i % 3 == 0 else rnd.randrange(1, users), i, t))
    return spark.createDataFrame(rows, "key long, event_id long, ts timestamp")


def expected_counts(rows, seconds):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.key, r.ts, r.event_id)):
        count, reset = state.get(r.key, (0, None))
        if reset is None or reset <= r.ts:
            count, reset = 1, r.ts + dt.timedelta(seconds=seconds)
        else:
            count += 1
        state[r.key] = (count, reset)
        out[r.event_id] = count
    return out


@pytest.mark.parametrize("seconds", [60, 1800])
def test_rate_limit(spark, tmp_path, seconds):
    df = events(spark)
    want = expected_counts(df.collect(), seconds)
    for windows in (1, 3, 64):
        batch = {r.event_id: r for r in jobs.rate_limit_batch(df, 3, seconds, windows).collect()}
        assert {k: r.request_count for k, r in batch.items()} == want
    assert all(r.allowed == (r.request_count <= 3) for r in batch.values())
    write_files(spark, df, f"{tmp_path}/in", 5, "event_id")
    jobs.run_available(jobs.rate_limit(stream(spark, f"{tmp_path}/in", df.schema), 3, seconds), f"{tmp_path}/out")
    got = {r.event_id: r.request_count for r in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    assert got == want


def test_ingest_drops_repeats_across_batches(spark, tmp_path):
    rows = [(f"https://x/{i % 30}{'?utm_source=a' if i % 2 else ''}", "about GPT" if i % 10 else "nothing", START + dt.timedelta(minutes=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "url string, raw_content string, fetched_at timestamp")
    write_files(spark, df, f"{tmp_path}/in", 4, "fetched_at")
    jobs.run_available(jobs.ingest(stream(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out")
    got = sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out/data").collect())
    assert got == sorted({r[0].split("?")[0] for r in rows if r[1] == "about GPT"})


def test_insert_new_is_repeatable(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = jobs.insert_new(path)
    one = spark.createDataFrame([("a", START), ("a", START), ("b", START)], "url string, fetched_at timestamp")
    two = spark.createDataFrame([("b", START), ("c", START)], "url string, fetched_at timestamp")
    for batch, i in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, i)
    assert sorted(r.url for r in KeyedTable(spark, path, one.schema, ["url"]).read().collect()) == ["a", "b", "c"]


def test_route_late(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-30 00:00:00"), ("b", "2023-11-01 00:00:00"), ("k", "2024-01-30 00:00:00"), ("n", None)], "url string, published_at string")
    df = df.withColumn("published_at", F.col("published_at").cast("timestamp"))
    known = spark.createDataFrame([("k",)], "url string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    writer = jobs.route_late(f"{tmp_path}/new", f"{tmp_path}/late", known, "2024-01-31 10:00:00")
    jobs.run_available(stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/q", writer=writer)
    assert {r.url for r in spark.read.parquet(f"{tmp_path}/new").collect()} == {"a", "n"}
    assert {(r.url, r.reason) for r in spark.read.parquet(f"{tmp_path}/late").collect()} == {("b", "too_old"), ("k", "known_url")}


def test_feedback_counts_latest_votes(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(6), rnd.randrange(4), rnd.choice([-1, 0, 1]), START + dt.timedelta(minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, target_id long, feedback int, ts timestamp")
    write_files(spark, df, f"{tmp_path}/in", 4, "event_id")
    jobs.run_available(stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/q", writer=jobs.feedback(f"{tmp_path}/t"))
    last = jobs.vote_table(spark, f"{tmp_path}/t", df.schema).read()
    counters = {tuple(r) for r in jobs.counter_table(spark, f"{tmp_path}/t").read().collect()}
    assert counters == {tuple(r) for r in reports.feedback_counts(df).collect()}
    assert {tuple(r) for r in reports.feedback_counts(last).collect()} == {tuple(r) for r in reports.feedback_counts(df).collect()}


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path, schema = str(tmp_path), "event_id long, user_id long, target_id long, feedback int, ts timestamp"
    write = jobs.feedback(path, buckets=8)
    first = spark.createDataFrame([(i, i, i % 5, 1, START) for i in range(60)], schema)
    write(first, 0)
    before = files(f"{path}/votes/data")
    second = spark.createDataFrame([(100, 3, 3, -1, START + dt.timedelta(1)), (101, 7, 2, 0, START + dt.timedelta(1)), (102, 8, 3, -1, START - dt.timedelta(1))], schema)
    write(second, 1)
    votes, counters = jobs.vote_table(spark, path, schema, 8), jobs.counter_table(spark, path, 8)
    touched = set(votes.touched(second))
    assert 0 < len(touched) < 8
    after = files(f"{path}/votes/data")
    kept = {f: t for f, t in before.items() if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == t for f, t in kept.items())  # untouched files are the same files
    assert {v for v, b in votes.parts() if b in touched} == {1} and {v for v, b in votes.parts() if b not in touched} == {0}
    counts = {r.target_id: (r.up_count, r.down_count) for r in counters.read().collect()}
    assert counts[3] == (11, 1) and counts[2] == (11, 0) and counts[0] == (12, 0)  # the late vote of user 8 changed nothing
    write(second, 1)  # a batch that runs again
    assert counts == {r.target_id: (r.up_count, r.down_count) for r in counters.read().collect()}
    for i in range(2, 5):
        write(spark.createDataFrame([(100 + i, 3, 3, (-1) ** i, START + dt.timedelta(i))], schema), i)
    assert votes.versions() == [3, 4]
    held = {f.split("/data/")[1].rsplit("/", 1)[0] for f in files(f"{path}/votes/data")}
    assert held == {f"v={v}/_bucket={b}" for w in (None, 4) for v, b in votes.parts(w)}  # old versions are gone
    every = first.unionByName(second).unionByName(spark.createDataFrame([(104, 3, 3, 1, START + dt.timedelta(4))], schema))
    assert {tuple(r) for r in counters.read().collect()} == {tuple(r) for r in reports.feedback_counts(every).collect()}


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path):
    schema = "url string, n long"
    table = KeyedTable(spark, str(tmp_path), schema, ["url"], 4)
    assert table.read().count() == 0
    one, two = (spark.createDataFrame(rows, schema) for rows in ([("a", 1), ("b", 1)], [("a", 2), ("c", 2)]))
    table.commit(one, 0, table.touched(one), replace=True)
    two.withColumn("_bucket", table.bucket()).write.partitionBy("_bucket").parquet(f"{tmp_path}/data/v=1")  # no manifest
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 1)}
    table.commit(two, 1, table.touched(two), replace=False)
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 1), ("a", 2), ("c", 2)}
    assert {tuple(r) for r in table.read(before=1).collect()} == {("a", 1), ("b", 1)}


def test_windows_in_append_mode(spark, tmp_path):
    rows = [(i % 3, START + dt.timedelta(hours=i)) for i in range(96)]
    df = spark.createDataFrame(rows, "source_id long, fetched_at timestamp")
    write_files(spark, df, f"{tmp_path}/in", 6, "fetched_at")
    jobs.run_available(jobs.freshness(stream(spark, f"{tmp_path}/in", df.schema), "2 hours"), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out/data")
    full = df.groupBy(F.window("fetched_at", "24 hours", "1 hour").alias("w"), "source_id").agg(F.count("*").alias("n"))
    want = {(r.w.start, r.source_id): r.n for r in full.collect()}
    got = {(r.window_start, r.source_id): r.raw_rows for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_silence_alarm_by_timer(spark, tmp_path):
    hours = {1: [0, 10, 70], 2: list(range(0, 200, 5)), 3: [0]}
    rows = sorted((START + dt.timedelta(hours=h), s) for s, hs in hours.items() for h in hs)
    df = spark.createDataFrame(pd.DataFrame({"source_id": [s for _, s in rows], "fetched_at": [t for t, _ in rows]}), "source_id long, fetched_at timestamp")
    write_files(spark, df, f"{tmp_path}/in", 6, "fetched_at")
    jobs.run_available(jobs.silence(stream(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out")
    got = {(r.source_id, int((r.silent_since - START).total_seconds() // 3600)) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    assert got == {(1, 10), (1, 70), (3, 0)}
    batch = jobs.silence_batch(df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz")), "2024-01-09 03:00:00")
    assert {(r.source_id, int((r.silent_since - START).total_seconds() // 3600)) for r in batch.collect()} == got


def test_canary_percentiles_are_exact(spark, tmp_path):
    n = 60_000
    shuffled = F.col("id") * 7919 % n
    runs = spark.range(n).select(
        F.lit(START).cast("timestamp").alias("created_at"), F.lit(reports.ANSWER_SURFACE).alias("surface"), F.lit("s").alias("strategy"), (shuffled * shuffled).alias("latency_ms"),
        F.lit(1).alias("injected_count"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("int").alias("feedback"), F.lit("{}").alias("query_input"),
    )
    runs.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.run_available(jobs.canary(jobs.stream_table(spark, f"{tmp_path}/in", runs.schema)), f"{tmp_path}/out", "complete")
    (row,) = spark.read.parquet(f"{tmp_path}/out/data").collect()
    assert (row.requests, row.p50_latency_ms, row.p95_latency_ms) == (n, (n // 2 - 1) ** 2, (n * 95 // 100 - 1) ** 2)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables as folders of several files."""
    path = str(tmp_path_factory.mktemp("folders"))
    for name, key in (("documents", "doc_id"), ("events", "event_id")):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3, key).write.parquet(f"{path}/{name}.parquet")
    return Tables(spark, path)


def test_streams_follow_tables_stored_as_folders(spark, folders):
    got = {(r.source_id, r.window_start): r.raw_rows for r in stateful.freshness(folders).collect()}
    raw = folders.raw.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), F.date_trunc("hour", "fetched_at").alias("t"))
    raw = raw.select("source_id", F.expr("CAST(t - make_interval(0, 0, 0, 0, h) AS timestamp_ntz)").alias("w"))
    assert got and got == {(r.source_id, r.w): r["count"] for r in raw.groupBy("source_id", "w").count().collect()}
    assert stateful.rate_limit(folders).count() == folders.events.count()


def test_streams_follow_tables_stored_as_one_file(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    got = {(r.event_id, r.request_count, r.allowed) for r in stateful.rate_limit(tables).collect()}
    assert got and got == {(r.event_id, r.request_count, r.allowed) for r in stateful.rate_limit_batch(tables).collect()}
    assert stateful.freshness(tables).agg(F.sum("raw_rows")).first()[0] == 24 * tables.raw.count()


@pytest.mark.parametrize("name", ["a,b.parquet", "c{1}[d].parquet", "e e*.parquet"])
def test_a_stream_of_one_file_leaves_its_neighbours(spark, tmp_path, name):
    rows = spark.range(5).coalesce(1)
    for i, x in enumerate((name, "a", "b.parquet", "c1d.parquet", "e ee.parquet")):
        rows.withColumn("id", F.col("id") + 10 * i).toPandas().to_parquet(f"{tmp_path}/{x}")
    jobs.run_available(jobs.stream_table(spark, f"{tmp_path}/{name}", rows.schema), f"{tmp_path}/out")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/data").collect()) == [0, 1, 2, 3, 4]


def test_a_batch_arrives_in_more_files_than_one(spark, folders, monkeypatch):
    paths = []
    monkeypatch.setattr(stateful, "folder", lambda t, make=stateful.folder: paths.append(make(t)) or paths[-1])
    got = {(r.id, r.url) for r in stateful.insert_new(folders).collect()}
    first = folders.items.groupBy(tx.canonical_url("url").alias("url")).agg(F.min("id").alias("id"))
    assert got == {(r.id, r.url) for r in first.collect()}
    arrived = [p for p in paths if any(n.startswith("part-") for n in os.listdir(p.removeprefix("file:")))]
    assert len(arrived) == 1 and len(files(arrived[0].removeprefix("file:"))) == 4 * 3
