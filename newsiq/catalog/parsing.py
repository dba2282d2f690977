"""Catalog: parsers of nested and semi-structured inputs.

The driver tables hold no feeds, exports or subtitles, so each query first
writes whole rows of a driver table in the format and then parses them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.functions.jsontext import first_json
from newsiq.plans import analysis as an
from newsiq.plans import quality
from newsiq.sources import feeds


def _xml(x: str):
    return F.concat(F.lit("<![CDATA["), F.col(x), F.lit("]]>"))


# item 0 has all tags, 1 is an Atom entry, 2 has empty CDATA sections before the tags to fall back on;
# every tenth document goes on with forty more items, of which thirty in all are kept
@query(
    "src_3_parse_feeds",
    r"""SELECT doc_id, pos::INT AS pos, concat('https://ex.org/', doc_id, '/', pos) AS url, CASE WHEN pos < 2 THEN concat('t', doc_id) WHEN pos = 2 THEN '' ELSE concat('more ', pos) END AS title,
        CASE pos WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 1 THEN 'short' WHEN 2 THEN 'fallback' ELSE '' END AS content,
        CASE pos WHEN 0 THEN '2024-01-02T00:00:00Z' WHEN 2 THEN '2024-03-04' END AS published_at
      FROM (SELECT doc_id, text, unnest(range(CASE WHEN doc_id % 10 = 0 THEN 30 ELSE 3 END)) AS pos FROM documents WHERE text <> '') x""",
)
def parse_feeds(t):
    doc = F.col("doc_id").cast("string")
    link = lambda n: F.concat(F.lit("https://ex.org/"), doc, F.lit("/"), n.cast("string") if not isinstance(n, int) else F.lit(str(n)))
    more = F.transform(F.sequence(F.lit(3), F.lit(42)), lambda n: F.concat(F.lit("<item><title>more "), n.cast("string"), F.lit("</title><link>"), link(n), F.lit("</link></item>")))
    xml = F.concat(
        F.lit("<rss><channel><title>x</title><item><title>t"), doc, F.lit("</title><link> "), link(0), F.lit(" </link><description>"), _xml("text"),
        F.lit("</description><pubDate>2024-01-02T00:00:00Z</pubDate></item><item><title>no link</title></item><entry><title>t"), doc,
        F.lit("</title><link rel='alternate' href='"), link(1), F.lit("'/><summary>short</summary></entry><item><title><![CDATA[]]></title><link>"), link(2),
        F.lit("</link><description><![CDATA[]]></description><summary>fallback</summary><pubDate><![CDATA[]]></pubDate><updated>2024-03-04</updated></item>"),
        F.when(F.expr("doc_id % 10 = 0"), F.array_join(more, "")).otherwise(""), F.lit("</channel></rss>"),
    )
    return feeds.parse_feeds(t.documents.where("text <> ''").select("doc_id", xml.alias("xml")))


@query(
    "src_4_flatten_accounts",
    """SELECT concat('U', CAST(user_id AS VARCHAR)) AS handle, concat('https://x.com/U', CAST(user_id AS VARCHAR), '/status/', CAST(event_id AS VARCHAR)) AS url, concat('@U', CAST(user_id AS VARCHAR), ': ', event_type) AS raw_content,
      event_id % 9 AS likes, CAST(0 AS BIGINT) AS retweets FROM events""",
)
def flatten_accounts(t):
    handle = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    post = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text"),
        F.concat(F.lit("https://x.com/"), handle, F.lit("/status/"), F.col("event_id").cast("string")).alias("url"), F.expr("event_id % 9").alias("likes"),
    )
    bare = F.struct(F.lit(None).cast("string").alias("id"), F.lit("no id").alias("text"), F.lit("u").alias("url"), F.lit(0).cast("long").alias("likes"))
    account = F.struct(handle.alias("handle"), F.lit("b").alias("bio"), F.array(post, bare).alias("tweets"))
    docs = t.events.select(F.to_json(F.struct(F.array(account).alias("x"))).alias("json"))
    return feeds.flatten_accounts(docs).select("handle", "url", "raw_content", "likes", "retweets")


@query(
    "src_9_transcripts",
    r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS raw_content FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 200""",
)
def transcripts(t):
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), "text", F.lit("\n\n2\n00:00:02,000 --> 00:00:03,000\n"))
    return feeds.transcripts(t.conversations.select("conv_id", "turn", F.array(srt).alias("srt"))).select("conv_id", "turn", "raw_content")


@query(
    "src_10_raw_rows",
    """SELECT source_id, concat('https://x.com/i/web/status/', CAST(doc_id AS VARCHAR)) AS url, text AS raw_content, CAST(NULL AS VARCHAR) AS published_at FROM d
      UNION ALL SELECT source_id, concat('https://p/', CAST(doc_id AS VARCHAR)), concat('n: ', lang, ' (△ ', CAST(n_chars AS VARCHAR), ' votes)'), '2024-01-02' FROM d
      UNION ALL SELECT source_id, concat('https://c/', CAST(doc_id AS VARCHAR)), concat(lang, chr(10), chr(10), text), '2024-01-03' FROM d
      UNION ALL SELECT source_id, concat('https://q/', CAST(doc_id AS VARCHAR)), concat('show: ', lang, chr(10), chr(10), text), '2024-01-04' FROM d
      UNION ALL SELECT source_id, concat('https://github.com/o', CAST(doc_id AS VARCHAR), '/r'), concat('o', CAST(doc_id AS VARCHAR), '/r: ', lang, ' repo (★ 1', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), ' stars today)'), NULL FROM d
      UNION ALL SELECT source_id, concat('https://arxiv.org/abs/2401.', CAST(doc_id AS VARCHAR)), concat_ws(chr(10) || chr(10), 'T ' || lang, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')), '2024-01-05' FROM d
      UNION ALL SELECT source_id, concat('https://www.nowcoder.com/', CASE WHEN doc_id % 2 = 0 THEN 'feed/main/detail/u' ELSE 'discuss/' END, CAST(doc_id AS VARCHAR)), concat(lang, chr(10), chr(10), 'body ', CAST(doc_id AS VARCHAR), ' & more'), NULL
        FROM d QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY doc_id) <= 5""".replace(
        " FROM d", " FROM (SELECT *, CAST(substr(source, 4) AS BIGINT) AS source_id FROM documents) d"
    ),
)
def raw_rows(t):
    d = t.documents.withColumn("source_id", F.expr("CAST(substr(source, 4) AS BIGINT)"))
    doc = F.col("doc_id").cast("string")
    url = lambda p: F.concat(F.lit(p), doc)
    parts = {
        "posts": d.select("source_id", F.col("doc_id").cast("string").alias("id"), "text"),
        "voted": d.select("source_id", url("https://p/").alias("url"), F.lit("n").alias("name"), F.col("lang").alias("tagline"), F.col("n_chars").alias("votes"), F.lit("2024-01-02").alias("created_at")),
        "curated": d.select(
            "source_id", F.col("doc_id").cast("string").alias("id"), url("https://c/").alias("url"), F.col("lang").alias("title"), F.lit("e").alias("title_en"), F.col("text").alias("summary"),
            F.lit("c").alias("category"), F.lit("s").alias("source"), F.lit("2024-01-03").alias("published_at"),
        ),
        "podcasts": d.select("source_id", url("https://q/").alias("url"), F.lit("show").alias("name"), F.col("lang").alias("title"), F.col("text").alias("transcript"), F.lit("2024-01-04").alias("published_at")),
        "repos": d.select("source_id", F.concat(F.lit('<div></div><article class="b"><h2><a href="/o'), doc, F.lit('/r">x</a></h2><p class="col-9 m"> '), "lang", F.lit(' <b>repo</b></p><a href="/stargazers"><svg></svg> 1,'), F.lpad(F.expr("CAST(doc_id % 1000 AS STRING)"), 3, "0"), F.lit("</a></article><article>no link</article>")).alias("html")),
        "preprints": d.select("source_id", F.lit("cs").alias("category"), F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/2401."), doc, F.lit("</id><title> T "), "lang", F.lit("</title><summary>"), "text", F.lit("</summary><published> 2024-01-05 </published></entry><entry><id>x</id><title>no id</title></entry></feed>")).alias("xml")),
        "hot": d.select("source_id", F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("id"), F.concat(F.lit("u"), doc).alias("uuid"), F.when(F.expr("doc_id % 2 = 0"), 74).otherwise(1).alias("type"), F.col("lang").alias("title"),
            F.concat(F.lit('<script>window.__INITIAL_STATE__={"prefetchData":{"1":{},"2":{"ssrCommonData":{"contentData":{"content":"<p>body '), doc, F.lit(' &amp; more</p><style>x</style>"}}}}};</script>')).alias("html")),
    }
    return feeds.union_raw_rows(parts).select("source_id", "url", "raw_content", "published_at")


# an analysis of each document: some lack facts, sentences or limitations
def _payload(t):
    fact = lambda n: F.struct(F.expr(f"substring(text, {n})").alias("text"), F.when(F.expr("doc_id % 7 <> 6"), "opening").alias("evidence"))
    facts = F.when(F.expr("doc_id % 5 = 0"), F.array(fact(1), fact(2))).otherwise(F.array(fact(1), fact(2), fact(3)))
    why = F.when(F.expr("doc_id % 3 = 0"), "Too short.").otherwise("One a. Two b. Three c.")
    block = F.struct(
        facts.alias("facts"), why.alias("why_it_matters"), F.lit("A. B. C. D. E.").alias("deeper_interpretation"),
        F.array(F.lit("first"), F.lit("second")).alias("limitations_or_uncertainties"),
    )
    kind = F.when(F.expr("doc_id % 2 = 0"), "research_paper").otherwise("sports")
    return t.documents.select("doc_id", F.to_json(F.struct(kind.alias("article_type"), block.alias("en"), block.alias("zh"))).alias("payload"))


_FIRST_ERROR = """CASE WHEN doc_id % 5 = 0 THEN 'en.facts must contain 3-6 fact objects' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'en.facts[0].text is empty' WHEN doc_id % 7 = 6 THEN 'en.facts[0].evidence must be a string'
  WHEN doc_id % 3 = 0 THEN 'en.why_it_matters must contain at least 3 sentences' END"""


@query("prj_23_validate_analysis", f"SELECT doc_id, {_FIRST_ERROR} AS error FROM documents WHERE {_FIRST_ERROR} IS NOT NULL")
def validate_analysis(t):
    return quality.validate_analysis(_payload(t), "payload")[1].select("doc_id", "error")


@query(
    "prj_24_analysis_text",
    f"""SELECT doc_id, concat_ws(chr(10), 'Title: ' || lang, 'Article type: ' || CASE WHEN doc_id % 2 = 0 THEN 'research_paper' ELSE 'other' END, replace(b, chr(2), 'EN'), replace(b, chr(2), 'ZH')) AS analysis_text FROM (
      SELECT doc_id, lang, concat_ws(chr(10), chr(2) || ' facts:', '- ' || f(1) || ' (opening)', '- ' || f(2) || ' (opening)', '- ' || f(3) || ' (opening)', chr(2) || ' why it matters: One a. Two b. Three c.', chr(2) || ' deeper interpretation: A. B. C. D. E.', chr(2) || ' limitations: first | second') AS b
      FROM documents WHERE {_FIRST_ERROR} IS NULL) x""".replace("f(1)", "trim(substr(trim(regexp_replace(substr(text, 1), '\\s+', ' ', 'g')), 1, 360))")
    .replace("f(2)", "trim(substr(trim(regexp_replace(substr(text, 2), '\\s+', ' ', 'g')), 1, 360))")
    .replace("f(3)", "trim(substr(trim(regexp_replace(substr(text, 3), '\\s+', ' ', 'g')), 1, 360))"),
)
def analysis_text(t):
    good = quality.validate_analysis(_payload(t), "payload")[0].join(t.documents.select("doc_id", "lang"), "doc_id")
    return good.select("doc_id", an.to_text(F.col("analysis"), "lang").alias("analysis_text"))


@query("prj_29_first_json", "SELECT event_id, concat('{\"p\":', props, ',\"s\":\"}{\"}') AS found FROM events")
def first_json_query(t):
    text = F.concat(F.lit('reply: ```json {"p":'), "props", F.lit(',"s":"}{"} ``` and {"more": 1}'))
    return t.events.select("event_id", first_json(text).alias("found"))
