"""Dates written as text in feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsiq.functions.text import _c

# Layouts tried in order after ISO 8601.
LAYOUTS = (
    "EEE, d MMM yyyy HH:mm:ss z",
    "EEE, d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss Z",
    "EEE, d MMM yyyy HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "yyyy/MM/dd",
)


def parse_date(x: Column | str) -> Column:
    """UTC time of a date text as ``timestamp_ntz``; NULL when it is not a date."""
    raw = F.trim(_c(x))
    # weekday names in patterns are not accepted by the parser, so they are cut off
    text = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3,9},\s+", ""), r"\bSept\b", "Sep")
    text = F.regexp_replace(F.regexp_replace(text, r"^([A-Za-z]{3,9})\.", "$1"), r"\s+", " ")
    text = F.regexp_replace(text, r"\b(?:GMT|UTC|UT|Z)$", "+0000")
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    tries = [iso]
    for layout in LAYOUTS:
        if not layout.startswith("EEE"):
            tries.append(F.try_to_timestamp(text, F.lit(layout)))
    tries.append(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")))
    return F.coalesce(*tries).cast("timestamp_ntz")


def iso_or_text(x: Column | str) -> Column:
    """ISO 8601 in UTC when the text is a date, else the trimmed text; NULL when empty."""
    ts = parse_date(x)
    return F.coalesce(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.nullif(F.trim(_c(x)), F.lit(""))
    )
