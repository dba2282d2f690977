"""Digest delivery: claims per target and cadence, outcomes, summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsiq.functions.stats import count_if
from newsiq.operators.windows import latest_per


def due_cadences(day: dt.date) -> list[int]:
    """Monthly beats weekly; the daily brief always follows."""
    if day.day == 1:
        return [30, 1]
    return [7, 1] if day.weekday() == 0 else [1]


def claims(targets: DataFrame, briefs: DataFrame, sent: DataFrame, days: list[str]) -> DataFrame:
    """New delivery rows for the given days: (target, anchor_date, step_days, status).

    ``targets`` has target and lang.  Each day delivers the windows that ended
    the day before.  Targets whose language the brief has become ``pending``;
    when there is no brief, or no target can be served, all become
    ``skipped_empty_brief``.  Rows already in ``sent`` are not returned.
    """
    due = []
    for text in days:
        day = dt.date.fromisoformat(text)
        anchor = (day - dt.timedelta(days=1)).isoformat()
        for step in due_cadences(day):
            due.append(
                F.struct(
                    F.lit(anchor).cast("date").alias("anchor_date"), F.lit(step).cast("long").alias("step_days"),
                    F.lit(f"{text} 00:00:00").cast("timestamp_ntz").alias("today"),
                )
            )
    wanted = targets.select("target", "lang", F.inline(F.array(*due)))
    newest = latest_per(briefs, ["anchor_date", "step_days"], [F.col("generated_at").desc(), F.col("brief_id").desc()])
    newest = newest.select("anchor_date", F.col("step_days").cast("long").alias("step_days"), "synthesis_en", "synthesis_zh", "generated_at")
    rows = wanted.join(newest, ["anchor_date", "step_days"], "left")
    fresh = (F.col("step_days") != 1) | (F.col("generated_at") >= F.col("today"))
    text = F.when(F.col("lang") == "zh", F.col("synthesis_zh")).otherwise(F.col("synthesis_en"))
    rows = rows.withColumn("ok", F.coalesce(fresh & (F.coalesce(text, F.lit("")) != ""), F.lit(False)))
    served = rows.where("ok").select("anchor_date", "step_days", F.lit(True).alias("served")).distinct()
    rows = rows.join(served, ["anchor_date", "step_days"], "left")
    status = F.when(F.col("ok"), "pending").when(F.col("served").isNull(), "skipped_empty_brief")
    rows = rows.withColumn("status", status).where(F.col("status").isNotNull())
    rows = rows.select("target", "anchor_date", "step_days", "status")
    return rows.join(sent.select("target", "anchor_date", F.col("step_days").cast("long").alias("step_days")), ["target", "anchor_date", "step_days"], "left_anti")


def outcomes(sent: DataFrame, results: DataFrame) -> DataFrame:
    """Delivery table after results (target, anchor_date, step_days, error): sent, or failed with the error."""
    keys = ["target", "anchor_date", "step_days"]
    res = results.select(*keys, F.substring("error", 1, 500).alias("last_error"), F.lit(True).alias("_done"))
    out = sent.join(res, keys, "left")
    status = F.when(F.col("_done") & F.col("last_error").isNull(), "sent").when(F.col("_done"), "failed").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_done")


def summary(sent: DataFrame) -> DataFrame:
    """Per-window counts by status."""
    return sent.groupBy("anchor_date", "step_days").agg(
        F.count("*").alias("targets"),
        *[count_if(F.col("status") == s).alias(s) for s in ("pending", "sent", "failed", "skipped_empty_brief")],
    )
