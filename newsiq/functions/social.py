"""Keys and aliases of social sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsiq.functions.text import _c

_CHANNEL = "(UC[a-zA-Z0-9_-]{20,})"
# Places where a channel id appears, tried in order.
CHANNEL_PATTERNS = (
    rf"[?&]channel_id={_CHANNEL}",
    rf"youtube\.com/channel/{_CHANNEL}",
    rf'"browseEndpoint":\{{"browseId":"{_CHANNEL}"',
    rf'"channelId":"{_CHANNEL}"',
    rf'"externalId":"{_CHANNEL}"',
    rf"""(?i)itemprop=["']channelId["'][^>]+content=["'](?-i:{_CHANNEL})["']""",
)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def channel_id(x: Column | str) -> Column:
    """Channel id found in a URL or page payload, else NULL."""
    text = F.replace(F.replace(_c(x), F.lit("\\u0026"), F.lit("&")), F.lit('\\"'), F.lit('"'))
    return F.coalesce(*[_first(text, p) for p in CHANNEL_PATTERNS])


def social_key(x: Column | str) -> Column:
    """One key per source however its URL is written; empty text gives an empty key."""
    raw = F.trim(F.coalesce(_c(x), F.lit("")))
    url = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)"
    scheme = F.lower(F.regexp_extract(raw, url, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(raw, url, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(raw, url, 3), "/+$", "")
    handle = F.when(host.isin("youtube.com", "youtu.be"), _first(path, "^/@([^/]+)$"))
    bare = _first(raw, "^@?([A-Za-z0-9._-]+)$")
    return (
        F.when(raw == "", "")
        .when(channel_id(raw).isNotNull(), F.concat(F.lit("youtube:channel:"), channel_id(raw)))
        .when(handle.isNotNull(), F.concat(F.lit("youtube:@"), F.lower(handle)))
        .when(scheme != "", F.concat(scheme, F.lit("://"), host, path))
        .when(bare.isNotNull(), F.concat(F.lit("youtube:@"), F.lower(bare)))
        .otherwise(F.lower(raw))
    )


def feed_candidates(x: Column | str) -> Column:
    """The URL itself and, for a subreddit, its two fallback feeds, in order."""
    raw = F.trim(F.coalesce(_c(x), F.lit("")))
    sub = _first(raw, r"(?i)reddit\.com/r/([^/.?#]+)")
    return (
        F.when(raw == "", F.array().cast("array<string>"))
        .when(sub.isNull(), F.array(raw))
        .otherwise(
            F.array(
                raw,
                F.concat(F.lit("https://old.reddit.com/r/"), sub, F.lit(".rss")),
                F.concat(F.lit("https://www.reddit.com/r/"), sub, F.lit("/new/.rss")),
            )
        )
    )


def thread_handle(url: Column | str) -> Column:
    """Author handle of a post URL, lower-cased, else NULL."""
    return F.lower(_first(_c(url), r"x\.com/([^/]+)/status/"))
