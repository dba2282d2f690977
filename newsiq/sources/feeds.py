"""Feeds, social exports and listings parsed into common item rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.functions import social as so
from newsiq.functions import text as tx
from newsiq.operators.joins import known_urls
from newsiq.operators.windows import latest_per, top_per

MAX_ITEMS = 30
# Feed tags that carry content and dates, in order.
CONTENT_TAGS = ("content", "content:encoded", "media:description", "description", "summary")
DATE_TAGS = ("pubDate", "published", "updated", "dc:date")


def _tag(block: Column, tag: str) -> Column:
    """Text of a tag; NULL when missing or empty.

    A tag with a CDATA section has that section's text, also an empty one;
    what stands around it counts only without a section.
    """
    section = rf"(?is)<{tag}[^>]*><!\[CDATA\[(.*?)\]\]></{tag}>"
    whole = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
    text = F.when(block.rlike(section), F.regexp_extract(block, section, 1)).otherwise(F.regexp_extract(block, whole, 1))
    return F.nullif(text, F.lit(""))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


# Patterns of a feed's items and of an Atom link.
ITEM = r"(?s)<(?:item|entry)>(.*?)</(?:item|entry)>"
ATOM_LINK = r"""(?i)<link[^>]+href=["']([^"']+)["']"""


def parse_feeds(docs: DataFrame, text_col: str = "xml", max_items: int = MAX_ITEMS) -> DataFrame:
    """Items of RSS and Atom documents: url, title, content, published_at, pos.

    Items without a URL are skipped; the first ``max_items`` with one are kept
    per document, in document order.
    """
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(ITEM), F.lit(1))

    def item(b: Column) -> Column:
        atom = F.nullif(F.regexp_extract(b, ATOM_LINK, 1), F.lit(""))
        return F.struct(
            _trim(F.coalesce(atom, _tag(b, "link"), _tag(b, "guid"))).alias("url"),
            _trim(F.coalesce(_tag(b, "title"), F.lit(""))).alias("title"),
            _trim(F.coalesce(*[_tag(b, t) for t in CONTENT_TAGS], F.lit(""))).alias("content"),
            _trim(F.coalesce(*[_tag(b, t) for t in DATE_TAGS])).alias("published_at"),
        )

    items = F.slice(F.filter(F.transform(blocks, item), lambda i: i["url"].isNotNull()), 1, max_items)
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(items).alias("pos", "_i")).select(*keep, "pos", "_i.*")


ACCOUNTS = T.StructType(
    [
        T.StructField(
            "x",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("handle", T.StringType()),
                        T.StructField("bio", T.StringType()),
                        T.StructField(
                            "tweets",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("id", T.StringType()),
                                        T.StructField("text", T.StringType()),
                                        T.StructField("url", T.StringType()),
                                        T.StructField("likes", T.LongType()),
                                        T.StructField("retweets", T.LongType()),
                                        T.StructField("createdAt", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def flatten_accounts(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Post rows of nested account exports; posts without id, text or url are dropped."""
    accounts = docs.select(F.explode(F.from_json(json_col, ACCOUNTS)["x"]).alias("a"))
    posts = accounts.select("a.handle", "a.bio", F.explode("a.tweets").alias("t"))
    ok = [F.coalesce(F.col(f"t.{c}"), F.lit("")) != "" for c in ("id", "text", "url")]
    posts = posts.where(ok[0] & ok[1] & ok[2])
    author = F.nullif(F.regexp_extract("t.url", r"x\.com/([^/]+)/status/", 1), F.lit(""))
    return posts.select(
        "handle", "bio", F.col("t.url").alias("url"),
        F.when(author.isNotNull(), F.concat(F.lit("@"), author, F.lit(": "), F.col("t.text"))).otherwise(F.col("t.text")).alias("raw_content"),
        F.coalesce("t.likes", F.lit(0)).alias("likes"), F.coalesce("t.retweets", F.lit(0)).alias("retweets"),
        F.col("t.createdAt").alias("published_at"),
    )


def transcripts(videos: DataFrame, srt_col: str = "srt", min_chars: int = 200) -> DataFrame:
    """Subtitle arrays as running text; videos with too little of it are dropped."""
    stamp = r"^\d{2}:\d{2}:\d{1,2},\d{3} --> "

    def one(srt: Column) -> Column:
        keep = lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"^\d+\s*$") & ~s.rlike(stamp)
        return F.array_join(F.filter(F.split(F.coalesce(srt, F.lit("")), r"\r?\n"), keep), " ")

    text = tx.squeeze(F.array_join(F.transform(F.col(srt_col), one), " "))
    return videos.withColumn("raw_content", text).where(F.length("raw_content") >= min_chars)


# ---------------------------------------------------------------- listings


def _repos(df: DataFrame) -> DataFrame:
    html = F.split(F.col("html"), r"(?i)<article\b")
    block = df.select("source_id", F.explode(F.slice(html, F.lit(2), F.size(html))).alias("b"))
    path = F.regexp_extract("b", r'href="(/[^"/]+/[^"/]+)"', 1)
    desc = tx.squeeze(F.regexp_replace(F.regexp_extract("b", r"(?is)<p[^>]*col-9[^>]*>(.*?)</p>", 1), "<[^>]+>", ""))
    stars = F.regexp_replace(F.regexp_extract("b", r"(?is)stargazers[^>]*>.*?</svg>\s*([\d,]+)", 1), ",", "")
    name = F.expr("substring(path, 2)")
    rows = block.select("source_id", path.alias("path"), desc.alias("desc"), stars.alias("stars")).where("path <> ''")
    content = F.concat(
        name,
        F.when(F.col("desc") != "", F.concat(F.lit(": "), F.col("desc"))).otherwise(""),
        F.when(F.col("stars") != "", F.concat(F.lit(" (★ "), F.col("stars"), F.lit(" stars today)"))).otherwise(""),
    )
    return rows.select(
        "source_id", F.concat(F.lit("https://github.com"), "path").alias("url"), content.alias("raw_content"),
        F.create_map(F.lit("stars"), F.when(F.col("stars") != "", F.col("stars")).otherwise("0")).alias("metadata"),
    )


def _voted(df: DataFrame) -> DataFrame:
    content = F.concat("name", F.lit(": "), "tagline", F.lit(" (△ "), F.col("votes").cast("string"), F.lit(" votes)"))
    return df.select(
        "source_id", "url", content.alias("raw_content"), F.create_map(F.lit("votes"), F.col("votes").cast("string")).alias("metadata"),
        F.col("created_at").alias("published_at"),
    )


STATE = T.StructType(
    [
        T.StructField(
            "prefetchData",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "ssrCommonData",
                            T.StructType([T.StructField("contentData", T.StructType([T.StructField("content", T.StringType())]))]),
                        )
                    ]
                ),
            ),
        )
    ]
)


def embedded_state_text(html: Column | str) -> Column:
    """Post body from the JSON state assigned in a page's script, as plain text; empty when missing."""
    from newsiq.functions.jsontext import first_json

    after = F.regexp_extract(tx._c(html), r"(?s)window\.__INITIAL_STATE__(.*)$", 1)
    state = F.from_json(first_json(after), STATE)
    bodies = F.transform(F.map_values(state["prefetchData"]), lambda v: v["ssrCommonData"]["contentData"]["content"])
    body = F.get(F.filter(bodies, lambda b: F.coalesce(b, F.lit("")) != ""), F.lit(0))
    out = F.regexp_replace(F.regexp_replace(body, r"(?is)<style[^>]*>.*?</style>", ""), r"(?is)<script[^>]*>.*?</script>", "")
    out = tx.decode_entities(F.regexp_replace(out, "<[^>]+>", " "), ("amp", "lt", "gt", "nbsp", "quot", "#39"))
    return F.coalesce(tx.squeeze(F.regexp_replace(out, r"&#\d+;", "")), F.lit(""))


def _hot(df: DataFrame, top: int = 5) -> DataFrame:
    """Hot list items (ordinal, id, uuid, type, title, html); the feature is the top five."""
    rows = df.where(F.coalesce("title", F.lit("")) != "")
    rows = top_per(rows, ["source_id"], [F.col("ordinal")], top)
    url = F.when(F.col("type") == 74, F.concat(F.lit("https://www.nowcoder.com/feed/main/detail/"), "uuid")).otherwise(
        F.concat(F.lit("https://www.nowcoder.com/discuss/"), F.col("id").cast("string"))
    )
    rows = rows.withColumn("_body", embedded_state_text("html"))
    content = F.when(F.col("_body") != "", F.concat("title", F.lit("\n\n"), "_body")).otherwise(F.col("title"))
    return rows.select("source_id", url.alias("url"), content.alias("raw_content"))


def _preprints(df: DataFrame) -> DataFrame:
    """Atom replies (source_id, category, xml) of a preprint archive."""
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    rows = df.select("source_id", "category", F.explode(entries).alias("e"))
    pick = lambda p: F.regexp_extract("e", p, 1)
    title, summary = tx.squeeze(pick(r"(?s)<title>(.*?)</title>")), tx.squeeze(pick(r"(?s)<summary>(.*?)</summary>"))
    ident = pick(r"<id>https?://arxiv\.org/abs/([\d.]+)")
    rows = rows.where((ident != "") & F.col("e").rlike(r"(?s)<title>.*?</title>"))
    return rows.select(
        "source_id", F.concat(F.lit("https://arxiv.org/abs/"), ident).alias("url"),
        F.when(summary != "", F.concat(title, F.lit("\n\n"), summary)).otherwise(title).alias("raw_content"),
        F.create_map(F.lit("category"), F.col("category")).alias("metadata"),
        F.nullif(F.trim(pick(r"(?s)<published>(.*?)</published>")), F.lit("")).alias("published_at"),
    )


def _curated(df: DataFrame) -> DataFrame:
    ok = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    content = F.when(F.coalesce("summary", F.lit("")) != "", F.concat("title", F.lit("\n\n"), "summary")).otherwise(F.col("title"))
    meta = F.create_map(
        F.lit("title_en"), F.col("title_en"), F.lit("category"), F.col("category"), F.lit("source"), F.col("source"), F.lit("aihot_id"), F.col("id")
    )
    return df.where(ok).select("source_id", "url", content.alias("raw_content"), meta.alias("metadata"), "published_at")


def _podcasts(df: DataFrame) -> DataFrame:
    ok = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("transcript", F.lit("")) != "")
    return df.where(ok).select(
        "source_id", "url", F.concat("name", F.lit(": "), "title", F.lit("\n\n"), "transcript").alias("raw_content"),
        F.create_map(F.lit("show_name"), F.col("name")).alias("metadata"), "published_at",
    )


def _posts(df: DataFrame) -> DataFrame:
    return df.select("source_id", F.concat(F.lit("https://x.com/i/web/status/"), "id").alias("url"), F.col("text").alias("raw_content"))


KINDS = {
    "repos": _repos, "voted": _voted, "hot": _hot, "preprints": _preprints,
    "curated": _curated, "podcasts": _podcasts, "posts": _posts,
}
RAW_COLUMNS = {"source_id": "bigint", "url": "string", "raw_content": "string", "metadata": "map<string,string>", "published_at": "string"}


def to_raw_rows(kind: str, df: DataFrame) -> DataFrame:
    """One listing kind as common pending rows."""
    rows = KINDS[kind](df)
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW_COLUMNS.items()]
    return rows.select(*cols, F.lit("pending").alias("status"))


def union_raw_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """All listing kinds as one table."""
    return reduce(DataFrame.unionByName, [to_raw_rows(k, df) for k, df in parts.items()])


# ---------------------------------------------------------------- gates on item tables


def grade_authors(posts: DataFrame, *known: DataFrame, n: int = 3) -> DataFrame:
    """Net-new relevant posts of each author, best ``n`` by likes plus reposts.

    Ties go to the smaller URL.
    """
    new = known_urls(posts, *known).where(~F.col("is_known")).drop("is_known")
    new = new.where(tx.is_ai_relevant("raw_content")).withColumn("author", F.coalesce(so.thread_handle("url"), F.lit("unknown")))
    score = F.coalesce("likes", F.lit(0)) + F.coalesce("retweets", F.lit(0))
    return top_per(new, ["author"], [score.desc(), F.col("url")], n)


def limit_new_official(items: DataFrame, *known: DataFrame, n: int = 1, as_of: str | None = None) -> DataFrame:
    """First ``n`` new official items per source in feed order; other items pass.

    ``items`` has source_id, source_type, url, published_at and ``ordinal``.  A
    URL offered by several sources counts for the first of them only.
    """
    from newsiq.sources.tables import recent

    official = F.col("source_type") == "official_rss"
    rest = items.where(~official)
    mine = items.where(official).withColumn("url", tx.canonical_url("url"))
    if as_of is not None:
        mine = recent(mine, as_of)
    tables = [k.select(tx.canonical_url("url").alias("url")) for k in known]
    if tables:
        mine = known_urls(mine, *tables).where(~F.col("is_known")).drop("is_known")
    mine = latest_per(mine, ["source_id", "url"], [F.col("ordinal")])
    kept = top_per(mine, ["source_id"], [F.col("ordinal")], n)
    kept = latest_per(kept, ["url"], [F.col("ordinal"), F.col("source_id")])
    return rest.unionByName(kept.select(*items.columns))


def aliases(sources: DataFrame) -> DataFrame:
    """(source_id, name, alias): every key under which a social source may be mentioned.

    ``sources`` has rss_url and ``metadata`` as a string map.
    """
    meta = lambda k: F.element_at("metadata", k)
    fields = ("youtube_handle", "handle", "channel_url", "apify_start_url", "source_page")
    keys = [so.social_key("rss_url"), *[so.social_key(meta(f)) for f in fields]]
    channel = F.coalesce(meta("channel_id"), meta("youtube_channel_id"), so.channel_id("rss_url"))
    keys.append(F.when(channel.isNotNull(), F.concat(F.lit("youtube:channel:"), channel)))
    every = F.filter(F.array_distinct(F.array_compact(F.array(*keys))), lambda k: k != "")
    return sources.select("source_id", "name", "rss_url", F.explode(every).alias("alias"))


def match_alias(items: DataFrame, sources: DataFrame, url_col: str = "channel_url") -> tuple[DataFrame, DataFrame]:
    """(items with their source, unmatched items); an alias claimed twice goes to the larger id."""
    table = latest_per(aliases(sources), ["alias"], [F.col("source_id").desc()])
    keyed = items.withColumn("alias", so.social_key(url_col))
    return keyed.join(table, "alias"), keyed.join(table, "alias", "left_anti")


def author_bios(posts: DataFrame) -> DataFrame:
    """(handle, bio) of accounts with a bio, handles lower-cased."""
    has = posts.where((F.coalesce("handle", F.lit("")) != "") & (F.trim(F.coalesce("bio", F.lit(""))) != ""))
    return has.groupBy(F.lower("handle").alias("handle")).agg(F.max(F.trim("bio")).alias("bio"))


def merge_bios(existing: DataFrame, extracted: DataFrame) -> DataFrame:
    """Bio table after adding the handles not known yet; handles lower-cased.

    One row per handle; as a map per source it would grow with the accounts.
    """
    new = extracted.select(F.lower("handle").alias("handle"), "bio").where(F.coalesce("bio", F.lit("")) != "")
    new = new.groupBy("handle").agg(F.max("bio").alias("bio"))
    old = existing.select(F.lower("handle").alias("handle"), "bio")
    return old.unionByName(new.join(old, "handle", "left_anti"))


def bio_map(bios: DataFrame) -> Column:
    """Aggregate expression: handle to bio as one map, for one source's accounts."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("handle", "bio"))))


def official_metadata(items: DataFrame) -> DataFrame:
    """Metadata columns of official items: tier, organisation, hint, canonical URL, fingerprint, size, priority."""
    from newsiq.operators.dedup import fingerprint

    org = F.coalesce("organization", tx.infer_org("source_name", "source_url"))
    body = tx.strip_html("content", numeric_entities=False)
    out = items.withColumn("canonical_url", tx.canonical_url("url")).withColumn("_b", body).withColumn("organization", org)
    return out.select(
        *[c for c in items.columns if c not in ("organization", "dedupe_priority")],
        F.lit("official").alias("trust_tier"), "organization", F.col("source_url").alias("source_page"),
        tx.content_type_hint("canonical_url", "title", "_b").alias("content_type_hint"), "canonical_url",
        fingerprint("canonical_url", "title", "_b", "published_at", "organization").alias("fingerprint"),
        tx.usable_content("title", "_b", "published_at")["usable_chars"].alias("usable_content_chars"),
        F.coalesce("dedupe_priority", F.lit(100)).alias("dedupe_priority"),
    )
