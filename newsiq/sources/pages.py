"""HTML pages: readable text, outlinks, published dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx
from newsiq.functions.dates import iso_or_text

TEXT_CAP = 12_000
VISIBLE_CHARS = 80_000
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
# Meta tags that carry a date, as (attribute, value), in order.
DATE_METAS = (
    ("property", "article:published_time"),
    ("property", "og:article:published_time"),
    ("name", "article:published_time"),
    ("name", "datePublished"),
    ("itemprop", "datePublished"),
    ("name", "date"),
)
# JSON-LD date keys, in order.
JSON_DATES = ("datePublished", "dateCreated", "dateModified", "uploadDate")
# Dates in running text, in order.
VISIBLE_DATES = (
    rf"(?i){tx.ASCII_L}{_MONTH}[a-z]*\.?\s+\d{{1,2}},\s+20\d{{2}}{tx.ASCII_R}",
    rf"{tx.ASCII_L}20\d{{2}}-\d{{2}}-\d{{2}}{tx.ASCII_R}",
    rf"(?i){tx.ASCII_L}\d{{1,2}}\s+{_MONTH}[a-z]*\.?\s+20\d{{2}}{tx.ASCII_R}",
)


def _nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _clean(x: Column) -> Column:
    return tx.squeeze(tx.decode_entities(F.regexp_replace(x, "<[^>]+>", " ")))


def readable_text(html: Column | str, cap: int = TEXT_CAP) -> Column:
    """Headings and paragraphs longer than 20 characters of the main block.

    Paragraphs are added until ``cap`` characters are reached, which is part of
    what the text is defined as; the whole document is searched.
    """
    block = lambda tag: _nonempty(F.regexp_extract(tx._c(html), rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", 0))
    main = F.coalesce(block("article"), block("main"), tx._c(html))
    for tag in ("script", "style"):
        main = F.regexp_replace(main, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    main = F.regexp_replace(main, r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1>", " ")
    parts = F.regexp_extract_all(main, F.lit(r"(?is)<(h1|h2|h3|p)\b[^>]*>(.*?)</\1>"), F.lit(2))
    parts = F.filter(F.transform(parts, _clean), lambda p: F.length(p) > 20)
    joined = F.aggregate(
        parts,
        F.lit(""),
        lambda acc, p: F.when(F.length(acc) >= cap, acc).when(acc == "", p).otherwise(F.concat(acc, F.lit(" "), p)),
    )
    return tx.squeeze(joined)


def simple_text(html: Column | str) -> Column:
    """Text of all headings and paragraphs outside navigation, empty behind a subscription wall."""
    body = F.regexp_replace(tx._c(html), r"(?is)<(nav|header|footer|aside|script|style|noscript)\b[^>]*>.*?</\1>", " ")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<(p|h1|h2|h3)\b[^>]*>(.*?)</\1>"), F.lit(2))
    parts = F.filter(F.transform(parts, _clean), lambda p: p != "")
    text = tx.squeeze(F.array_join(parts, " "))
    lede = F.lower(F.substring(text, 1, 300))
    return F.when(lede.contains("subscribe") & lede.contains("sign in"), "").otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag: quoted either way or bare; NULL when absent."""
    quoted = [rf'(?i)\b{name}\s*=\s*"([^"]*)"', rf"(?i)\b{name}\s*=\s*'([^']*)'", rf"(?i)\b{name}\s*=\s*([^\s>\"']+)"]
    out = None
    for pattern in quoted:
        value = F.regexp_extract(tag, pattern, 1)
        out = F.when(tag.rlike(pattern), value) if out is None else out.when(tag.rlike(pattern), value)
    return out


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` on the page ``base``, dot segments removed; NULL for other schemes."""
    base, href = tx._c(base), F.trim(tx._c(href))
    pat = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?"
    scheme, host, path = (F.regexp_extract(base, pat, i) for i in (1, 2, 3))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    url = (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(root, path, F.regexp_extract(base, pat, 4), href))
        .otherwise(F.concat(root, folder, href))
    )
    return F.when(url.rlike(r"/\.\.?(?:/|$|[?#])"), _without_dots(url, pat)).otherwise(url)


def _without_dots(url: Column, pat: str) -> Column:
    path = F.regexp_extract(url, pat, 3)
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1)
    return F.concat(head, F.array_join(kept, "/"), rest)


def outlinks(pages: DataFrame, url_col: str = "url", html_col: str = "html", path_regex: str | None = None, key: str = "page_id") -> DataFrame:
    """(page, canonical link): distinct links to the page's own host.

    Without ``path_regex`` a link must lie below the page's path.
    """
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    rows = pages.select(key, F.col(url_col).alias("_base"), F.explode(tags).alias("_tag"))
    rows = rows.withColumn("_href", F.trim(tx.decode_entities(attribute(F.col("_tag"), "href")))).where("_href <> ''")
    rows = rows.withColumn("_url", resolve_url("_base", "_href"))
    pat = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]+)([^?#]*)"
    host = lambda c: F.lower(F.regexp_extract(c, pat, 1))
    path = lambda c: F.when(F.regexp_extract(c, pat, 2) == "", "/").otherwise(F.regexp_extract(c, pat, 2))
    rows = rows.where((host("_url") != "") & (host("_url") == host("_base")))
    allowed = path("_url").rlike(path_regex) if path_regex else path("_url").startswith(path("_base"))
    return rows.where(allowed).select(key, tx.canonical_url("_url").alias("link")).distinct()


def _first_tag(html: Column, tag: str, test) -> Column:
    """First tag of a kind that passes ``test``."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
    return F.get(F.filter(tags, test), F.lit(0))


def meta_content(html: Column | str, attr: str, value: str) -> Column:
    """``content`` of the first meta tag whose ``attr`` is ``value`` (any case), decoded; NULL when empty."""
    tag = _first_tag(tx._c(html), "meta", lambda t: F.lower(attribute(t, attr)) == value.lower())
    return _nonempty(F.trim(tx.decode_entities(attribute(tag, "content"))))


def _json_date(html: Column) -> Column:
    script = r"""(?is)<script\b[^>]*type=(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json)[^>]*>(.*?)</script>"""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(script), F.lit(1)), lambda b: F.trim(tx.decode_entities(b)))

    def one(body: Column) -> Column:
        top = [F.get_json_object(body, f"$.{k}") for k in JSON_DATES]
        # dates of nested objects: first match of the keys in document order
        nested = F.regexp_extract(body, rf'"(?:{"|".join(JSON_DATES)})"\s*:\s*"([^"]+)"', 1)
        return F.coalesce(*[_nonempty(t) for t in top], _nonempty(nested))

    return F.get(F.filter(F.transform(bodies, one), lambda d: d.isNotNull()), F.lit(0))


def _visible_date(html: Column) -> Column:
    early = _clean(F.substring(html, 1, VISIBLE_CHARS))
    return tx.let(early, lambda v: F.coalesce(*[_nonempty(F.regexp_extract(v, p, 0)) for p in VISIBLE_DATES]))


def published_text(html: Column | str) -> Column:
    """Date text of a page: meta tags, ``<time>``, JSON-LD, then dates in the first visible text."""
    html = tx._c(html)
    metas = [meta_content(html, a, v) for a, v in DATE_METAS]
    time_tag = _first_tag(html, "time", lambda t: attribute(t, "datetime").isNotNull())
    time_text = _nonempty(F.trim(tx.decode_entities(attribute(time_tag, "datetime"))))
    return F.coalesce(*metas, time_text, _json_date(html), _visible_date(html))


def published_at(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``published_at``: ISO 8601 where the text is a date, else the text found."""
    return pages.withColumn("_d", published_text(html_col)).withColumn("published_at", iso_or_text("_d")).drop("_d")


def articles(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as article candidates: canonical URL, title, body and date; empty ones dropped."""
    html = F.col(html_col)
    rel = _first_tag(html, "link", lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical"))
    canonical = _nonempty(F.trim(tx.decode_entities(attribute(rel, "href"))))
    inner = lambda tag: _nonempty(_clean(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))
    title = F.coalesce(meta_content(html, "property", "og:title"), meta_content(html, "name", "twitter:title"), inner("h1"), inner("title"), F.lit(""))
    out = pages.select(
        "*",
        tx.canonical_url(F.coalesce(canonical, F.col(url_col))).alias("canonical_url"),
        title.alias("title"),
        readable_text(html).alias("body"),
        iso_or_text(published_text(html)).alias("published_at"),
    )
    return out.where((F.length("body") >= 120) | (F.col("title") != ""))
