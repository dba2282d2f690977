"""Streaming forms of ingestion, enrichment, monitoring and limits.

Every job takes a streaming DataFrame and returns one, or a writer for
``foreachBatch``; the caller picks source, trigger and sink.  Results equal the
batch functions named in the docstrings.  Event times are ``timestamp``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsiq.functions import text as tx
from newsiq.functions.stats import rate, rate_of
from newsiq.operators.joins import known_urls
from newsiq.operators.sinks import new_rows
from newsiq.operators.windows import latest_per
from newsiq.plans import enrich as en
from newsiq.plans.reports import ANSWER_SURFACE, FALLBACK
from newsiq.streaming.keyed import KeyedTable


def ingest(items: DataFrame, watermark: str = "2 days", time: str = "fetched_at", gate: bool = True) -> DataFrame:
    """Relevant items, one per canonical URL within the watermark.

    Repeats that arrive later than the watermark are caught by
    :func:`insert_new` at the sink.  Batch twin: gate, then first row per URL.
    """
    rows = items.withColumn("url", tx.canonical_url("url"))
    if gate:
        rows = rows.where(tx.is_ai_relevant("raw_content"))
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["url"])


def insert_new(path: str, key: str = "url", order: str = "fetched_at", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that appends only rows whose key is not stored yet.

    The sink is a :class:`~newsiq.streaming.keyed.KeyedTable`: a batch reads
    the keys of the buckets that its own keys fall into, and adds files to
    those that get rows.  A batch that is run again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, path, batch.schema, [key], buckets)
        touched = table.touched(batch)
        fresh = new_rows(table.read(batch_id, touched), batch, key, [F.col(order)])
        table.commit(fresh, batch_id, touched, replace=False)

    return write


def route_late(news_path: str, late_path: str, known: DataFrame, as_of: str, days: int = 30) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: recent unknown items to one table, old or known ones to another with the reason."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cutoff = F.date_trunc("day", F.lit(as_of).cast("timestamp")) - F.expr(f"INTERVAL {int(days) - 1} DAYS")
        rows = known_urls(batch, known)
        old = F.coalesce(F.col("published_at").cast("timestamp") < cutoff, F.lit(False))
        rows = rows.withColumn("reason", F.when(old, "too_old").when(F.col("is_known"), "known_url")).drop("is_known")
        rows.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(f"{news_path}/batch_id={batch_id}")
        rows.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")

    return write


def enrich(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with their source's columns and outcome; batch twin :func:`newsiq.plans.enrich.route`."""
    src = sources.select("source_id", "source_type", F.col("category").alias("source_category"))
    return en.route(items.join(src, "source_id"))


def freshness(items: DataFrame, watermark: str = "1 day", window: str = "24 hours", slide: str = "1 hour", time: str = "fetched_at") -> DataFrame:
    """Rows and newest row per source over a sliding day."""
    rows = items.withWatermark(time, watermark)
    out = rows.groupBy(F.window(time, window, slide), "source_id").agg(F.count("*").alias("raw_rows"), F.max(time).alias("newest_raw_row_at"))
    return out.select("source_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "raw_rows", "newest_raw_row_at")


def canary(runs: DataFrame, watermark: str = "1 hour", window: str = "24 hours") -> DataFrame:
    """Volume and rates per tumbling window and strategy.

    Percentiles are exact: the state holds how often each distinct latency,
    in whole milliseconds, occurs in a window.
    """
    rows = runs.where(F.col("surface") == ANSWER_SURFACE).withWatermark("created_at", watermark)
    out = rows.groupBy(F.window("created_at", window), "strategy").agg(
        F.count("*").alias("requests"),
        *[F.expr(f"CAST(percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT)").alias(f"p{p}_latency_ms") for p in (50, 95)],
        rate(F.col("injected_count") == 0).alias("empty_candidate_rate"),
        rate(F.col("error_message").isNotNull()).alias("qa_error_rate"),
        F.coalesce(rate_of(F.col("feedback") < 0, F.col("feedback").isNotNull()), F.lit(0.0)).alias("negative_feedback_rate"),
        rate(F.get_json_object("query_input", "$.fallback_reason") == FALLBACK).alias("fallback_rate"),
    )
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


# ---------------------------------------------------------------- request limiter

_LIMIT_OUT = "key long, event_id long, ts timestamp, request_count long, allowed boolean"
_LIMIT_STATE = "request_count long, reset_at long"


def _count_requests(ts: pd.Series, count: int, reset_at: int, seconds: int) -> tuple[list[int], int, int]:
    """Counts of time-ordered requests of one key; a request at or after the reset opens a window."""
    out = []
    for t in ts.astype("int64"):
        if count == 0 or reset_at <= t:
            count, reset_at = 1, t + seconds * 1_000_000
        else:
            count += 1
        out.append(count)
    return out, count, reset_at


def rate_limit(events: DataFrame, limit: int, seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Count and verdict per request: the first opens a window of ``seconds``, the next ones add up.

    ``events`` has key, event_id and ts.  State is two numbers per key and is
    dropped once its window is over.  Batch twin: :func:`rate_limit_batch`.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset_at = state.get if state.exists else (0, 0)
        rows = pd.concat(list(chunks)).sort_values(["ts", "event_id"])
        counts, count, reset_at = _count_requests(rows["ts"].astype("datetime64[us]"), int(count), int(reset_at), seconds)
        state.update((count, reset_at))
        until = max(reset_at // 1000, state.getCurrentWatermarkMs()) + 1
        state.setTimeoutTimestamp(until)
        yield pd.DataFrame(
            {"key": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "request_count": counts, "allowed": [c <= limit for c in counts]}
        )

    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(step, _LIMIT_OUT, _LIMIT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows that arrive sorted by ``keys``."""
    parts, now = [], None
    for pdf in batches:
        for key, part in pdf.groupby(keys, sort=False):
            if key != now and parts:
                yield now, pd.concat(parts)
                parts = []
            now = key
            parts.append(part)
    if parts:
        yield now, pd.concat(parts)


def _transfer(times: np.ndarray, start: int, width: int) -> list[tuple[int, int, int]]:
    """How a segment moves the reset time: (latest incoming reset, outgoing reset, requests in the last window).

    ``times`` are the sorted request times of one key in one segment.  An
    incoming reset lies before ``start + width``; the first request at or after
    it opens a window, and so on to the end of the segment.
    """
    u = np.unique(times)
    following = np.searchsorted(u, u + width)
    entries = np.arange(min(len(u), np.searchsorted(u, start + width, side="right") + 1))
    last = entries.copy()
    while True:
        step = following[last]
        if (step >= len(u)).all():
            break
        last = np.where(step < len(u), np.minimum(step, len(u) - 1), last)
    tail = len(times) - np.searchsorted(times, u[last])
    return list(zip(u[entries].tolist(), (u[last] + width).tolist(), tail.tolist()))


def rate_limit_batch(events: DataFrame, limit: int, seconds: int, segment_windows: int = 64) -> DataFrame:
    """The same over a stored table, with the requests of one key split over time segments.

    A segment is many windows long.  First every segment says, for each reset
    time it might be handed, which one it hands on; only requests of its first
    window matter for that.  These short tables are walked once per key, and
    then every segment counts its own requests from the state it starts with.
    """
    width = seconds * 1_000_000
    length = width * segment_windows
    micros = F.unix_micros("ts")
    rows = events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("seg", F.floor(micros / length).cast("long"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, seg), part in _by_group(batches, ["key", "seg"]):
            t = part["us"].to_numpy()
            out = pd.DataFrame(_transfer(t, int(seg) * length, width), columns=["upto", "reset_out", "tail"])
            yield out.assign(key=key, seg=seg, requests=len(t))[["key", "seg", "upto", "reset_out", "tail", "requests"]]

    slim = rows.select("key", "seg", micros.alias("us")).repartition("key", "seg").sortWithinPartitions("key", "seg", "us")
    moves = slim.mapInPandas(tables, "key long, seg long, upto long, reset_out long, tail long, requests long")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, reset, count = None, 0, 0
        for (key, seg), part in _by_group(batches, ["key", "seg"]):
            if key != owner:
                owner, reset, count = key, 0, 0
            yield pd.DataFrame({"key": [key], "seg": [seg], "count_in": [count], "reset_in": [reset]})
            at = int(np.searchsorted(part["upto"].to_numpy(), reset))
            if at < len(part):
                reset, count = int(part["reset_out"].iloc[at]), int(part["tail"].iloc[at])
            else:
                # the window open before outlasts the segment's requests
                count += int(part["requests"].iloc[0])

    states = moves.repartition("key").sortWithinPartitions("key", "seg", "upto").mapInPandas(walk, "key long, seg long, count_in long, reset_in long")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, reset = None, 0, 0
        for pdf in batches:
            parts = []
            for group, part in pdf.groupby(["key", "seg"], sort=False):
                if group != now:
                    now, n, reset = group, int(part["count_in"].iloc[0]), int(part["reset_in"].iloc[0])
                counts, n, reset = _count_requests(part["ts"].astype("datetime64[us]"), n, reset, seconds)
                parts.append(part.assign(request_count=counts, allowed=[c <= limit for c in counts]))
            if parts:
                yield pd.concat(parts)[["key", "event_id", "ts", "request_count", "allowed"]]

    ready = rows.join(states, ["key", "seg"]).repartition("key", "seg").sortWithinPartitions("key", "seg", "ts", "event_id")
    return ready.mapInPandas(count, _LIMIT_OUT)


# ---------------------------------------------------------------- feedback and silence


VOTES = "event_id long, user_id long, target_id long, feedback int, ts timestamp_ntz"
COUNTERS = "target_id long, up_count long, down_count long"
_VOTER = ["user_id", "target_id"]


def vote_table(spark, path: str, schema: T.StructType | str = VOTES, buckets: int = 16) -> KeyedTable:
    """The latest vote per user and target that :func:`feedback` keeps."""
    return KeyedTable(spark, f"{path}/votes", schema, _VOTER, buckets)


def counter_table(spark, path: str, buckets: int = 16) -> KeyedTable:
    """The votes per target that :func:`feedback` keeps."""
    return KeyedTable(spark, f"{path}/counters", COUNTERS, ["target_id"], buckets)


def vote_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target_id, up, down): what the votes ``new`` change in the counters, against the votes ``old`` of the same users.

    A changed vote takes the old one back and adds the new one; a vote of 0
    only takes back; an equal one changes nothing.
    """
    side = lambda df, sign: df.select("target_id", (sign * (F.col("feedback") == 1).cast("long")).alias("up"), (sign * (F.col("feedback") == -1).cast("long")).alias("down"))
    both = side(old.join(new.select(*_VOTER), _VOTER, "left_semi"), -1).unionByName(side(new, 1))
    return both.groupBy("target_id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def feedback(path: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of votes and of the counters per target, kept from changes alone.

    A batch's votes are reduced to the latest per user and target; a stored
    vote that is later stays.  Both tables are keyed: only the buckets of the
    batch's voters, and of the targets whose counters change, are read and
    written.  Batch twin: :func:`newsiq.plans.reports.feedback_counts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = [F.col("ts").desc(), F.col("event_id").desc()]
        votes, counters = vote_table(spark, path, batch.schema, buckets), counter_table(spark, path, buckets)
        latest = latest_per(batch, _VOTER, order).persist()
        touched = votes.touched(latest)
        old = votes.read(batch_id, touched)
        # both commits may be made again from what was stored before this version
        votes.commit(latest_per(old.unionByName(latest), _VOTER, order), batch_id, touched, replace=True)
        newer = votes.read(batch_id + 1, touched).join(latest.select(*_VOTER), _VOTER, "left_semi")
        # a target without votes any more keeps a row of zeros; the first vote makes the row
        changes = vote_changes(old, newer).persist()
        at = counters.touched(changes)
        before = counters.read(batch_id, at)
        sums = before.select("target_id", F.col("up_count").alias("up"), F.col("down_count").alias("down")).unionByName(changes)
        counted = sums.groupBy("target_id").agg(F.sum("up").cast("long").alias("up_count"), F.sum("down").cast("long").alias("down_count"))
        counters.commit(counted, batch_id, at, replace=True)
        changes.unpersist()
        latest.unpersist()

    return write


_SILENCE_OUT = "source_id long, silent_since timestamp, noticed_at timestamp"


def silence(items: DataFrame, hours: int = 48, watermark: str = "1 hour", time: str = "fetched_at") -> DataFrame:
    """An alarm per source once it has been silent for more than ``hours``.

    Silence inside a batch is seen from the gaps between its rows, silence at
    the end by an event-time timer.  Batch twin: :func:`silence_batch`.
    """
    gap = hours * 3_600_000_000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        if state.hasTimedOut:
            found.append((state.get[0], state.get[0] + gap))
            state.remove()
        else:
            times = sorted(t for pdf in chunks for t in pdf["ts"].astype("datetime64[us]").astype("int64"))
            last = state.get[0] if state.exists else None
            for t in times:
                if last is not None and t - last > gap:
                    found.append((last, last + gap))
                last = t if last is None else max(last, t)
            state.update((last,))
            # the alarm is due just after the allowed gap
            due = (last + gap) // 1000 + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                found.append((last, last + gap))
                state.remove()
        at = lambda i: pd.to_datetime([f[i] for f in found], unit="us")
        if found:
            yield pd.DataFrame({"source_id": key[0], "silent_since": at(0), "noticed_at": at(1)})

    rows = items.select("source_id", F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("source_id").applyInPandasWithState(step, _SILENCE_OUT, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def silence_batch(items: DataFrame, as_of: str, hours: int = 48, time: str = "fetched_at") -> DataFrame:
    """Gaps of more than ``hours`` between rows of a source, and up to ``as_of``.

    Rows are reduced to the first and last of each hour before they are put in
    order, so a busy source does not fill a task; a longer gap cannot lie inside
    one hour.
    """
    from pyspark.sql import Window

    hour = items.groupBy("source_id", F.date_trunc("hour", time).alias("h")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    w = Window.partitionBy("source_id").orderBy("h")
    rows = hour.withColumn("next", F.coalesce(F.lead("lo").over(w), F.lit(as_of).cast("timestamp_ntz")))
    limit = F.expr(f"INTERVAL {int(hours)} HOURS")
    return rows.where(F.col("next") > F.col("hi") + limit).select("source_id", F.col("hi").alias("silent_since"), (F.col("hi") + limit).alias("noticed_at"))


# ---------------------------------------------------------------- running


def run_available(stream: DataFrame, path: str, mode: str = "append", writer: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything that has arrived and stop; state and results live under ``path``.

    ``complete`` results replace the table with each batch.
    """
    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data")

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if writer is not None:
        query = query.foreachBatch(writer)
    elif mode == "append":
        query = query.format("parquet").option("path", f"{path}/data")
    else:
        query = query.foreachBatch(replace)
    query.start().awaitTermination()


def stream_table(spark, path: str, schema: T.StructType) -> DataFrame:
    """File stream over a parquet table: one file, or a folder of them.

    The source takes a plain path for that of a folder, so a file is named by a pattern that only it matches.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place) and store.getFileStatus(place).isFile():
        folder, _, name = re.sub(r"([][{}*?,\\])", r"\\\1", path).rpartition("/")
        path = f"{folder}/{{{name}}}" if folder else f"{{{name}}}"
    return spark.readStream.schema(schema).parquet(path)


__all__ = [
    "canary", "counter_table", "enrich", "feedback", "freshness", "ingest", "insert_new", "rate_limit", "rate_limit_batch",
    "route_late", "run_available", "silence", "silence_batch", "stream_table", "vote_changes", "vote_table",
]
