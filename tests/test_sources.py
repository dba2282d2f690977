"""Parsers on inline documents."""

from pyspark.sql import functions as F

from newsiq.sources import feeds, pages


def test_feed_items(spark):
    rss = (
        "<rss><item><title>A</title><link>https://a</link><description><![CDATA[<p>x</p>]]></description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>"
        "<item><title>none</title></item><item><guid>https://g</guid><content:encoded>body</content:encoded></item></rss>"
    )
    atom = "<feed><entry><title>B</title><link href='https://b'/><summary>s</summary><updated>2024-01-03</updated></entry></feed>"
    docs = spark.createDataFrame([(1, rss), (2, atom)], "d int, xml string")
    rows = feeds.parse_feeds(docs).orderBy("d", "pos").collect()
    assert [(r.d, r.url, r.title, r.content) for r in rows] == [
        (1, "https://a", "A", "<p>x</p>"),
        (1, "https://g", "", "body"),
        (2, "https://b", "B", "s"),
    ]
    assert rows[2].published_at == "2024-01-03"
    assert feeds.parse_feeds(docs, max_items=1).count() == 2


def test_embedded_state(spark):
    html = """<script>window.__INITIAL_STATE__ = {"prefetchData":{"2":{"ssrCommonData":{"contentData":{"content":"<p>Hi &amp; {bye}</p>"}}}}}; x</script>"""
    df = spark.createDataFrame([(html,), ("none",)], "h string")
    assert [r[0] for r in df.select(feeds.embedded_state_text("h")).collect()] == ["Hi & {bye}", ""]


def test_listing_kinds(spark):
    repo = """<article class="x"><h2><a href="/own/repo">r</a></h2><p class="col-9 y">A <b>fast</b> tool</p><a href="/own/repo/stargazers"><svg></svg> 1,234</a></article>"""
    rows = feeds.to_raw_rows("repos", spark.createDataFrame([(1, "head" + repo)], "source_id long, html string")).collect()
    assert rows[0].url == "https://github.com/own/repo"
    assert rows[0].raw_content == "own/repo: A fast tool (★ 1234 stars today)"
    atom = "<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A\n title</title><summary> s </summary><published>2024-01-01</published></entry>"
    row = feeds.to_raw_rows("preprints", spark.createDataFrame([(2, "cs.AI", atom)], "source_id long, category string, xml string")).first()
    assert (row.url, row.raw_content, row.metadata) == ("https://arxiv.org/abs/2401.00001", "A title\n\ns", {"category": "cs.AI"})
    hot = spark.createDataFrame(
        [(3, i, 10 + i, f"u{i}", 74 if i == 0 else 1, f"t{i}", "") for i in range(7)],
        "source_id long, ordinal int, id long, uuid string, type int, title string, html string",
    )
    urls = sorted(r.url for r in feeds.to_raw_rows("hot", hot).collect())
    assert len(urls) == 5 and "https://www.nowcoder.com/feed/main/detail/u0" in urls


def test_transcripts(spark):
    words = " ".join(["word"] * 60)
    srt = f"1\n00:00:01,000 --> 00:00:02,000\n{words}\n\n2\n00:00:02,000 --> 00:00:03,000\nend\n"
    df = spark.createDataFrame([("v", [srt]), ("short", ["1\nhi"])], "id string, srt array<string>")
    rows = feeds.transcripts(df).collect()
    assert [(r.id, r.raw_content) for r in rows] == [("v", words + " end")]


def test_aliases(spark):
    df = spark.createDataFrame(
        [(1, "n", "https://www.youtube.com/@DwarkeshPatel", {"youtube_handle": "@DwarkeshPatel", "channel_id": "UCXl4i9dYBrFOabk0xGmbkRA"})],
        "source_id long, name string, rss_url string, metadata map<string,string>",
    )
    found = {r.alias for r in feeds.aliases(df).collect()}
    assert found == {"youtube:@dwarkeshpatel", "youtube:channel:UCXl4i9dYBrFOabk0xGmbkRA"}


def test_merge_bios_keeps_old(spark):
    old = spark.createDataFrame([("a", "old")], "handle string, bio string")
    new = spark.createDataFrame([("A", "new"), ("B", "b"), ("c", "")], "handle string, bio string")
    assert {(r.handle, r.bio) for r in feeds.merge_bios(old, new).collect()} == {("a", "old"), ("b", "b")}


PAGE = """<html><head><meta content="2026-05-28T00:00:00Z" property='article:published_time'><link rel="alternate canonical" href="https://x.org/a?utm_source=q">
<title>T</title></head><body><nav><p>navigation paragraph that is long</p></nav><main><article><h1>Heading that is long enough</h1><p>short</p>
<p>First paragraph with &quot;quotes&quot; inside.</p><form><p>hidden text in a form element</p></form></article></main>
<a href="/b/">b</a><a href='c?x=1#f'>c</a><a href="https://other.org/d">d</a><a href="../e">e</a><a href="mailto:x@y">m</a></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, "https://x.org/p/q", PAGE)], "page_id long, url string, html string")
    row = pages.articles(df).first()
    assert row.body == 'Heading that is long enough First paragraph with "quotes" inside.'
    assert (row.canonical_url, row.title, row.published_at) == ("https://x.org/a", "Heading that is long enough", "2026-05-28T00:00:00.000Z")
    links = {r.link for r in pages.outlinks(df, path_regex="^/").collect()}
    assert links == {"https://x.org/b", "https://x.org/p/c?x=1", "https://x.org/e"}
    assert {r.link for r in pages.outlinks(df).collect()} == set()


def test_published_date_order(spark):
    cases = [
        ("<time datetime='2024-01-02'></time><p>Jan 5, 2024</p>", "2024-01-02T00:00:00.000Z"),
        ('<script type="application/ld+json">{"@graph":[{"dateModified":"2024-02-01"}]}</script>', "2024-02-01T00:00:00.000Z"),
        ('<script type="application/ld+json">{"dateModified":"2024-02-01","datePublished":"2024-01-31"}</script>', "2024-01-31T00:00:00.000Z"),
        ("<p>Posted 3 Mar 2024</p>", "2024-03-03T00:00:00.000Z"),
        ("<p>nothing</p>", None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.published_at for r in pages.published_at(df).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_cap_is_reached_by_the_crossing_paragraph(spark):
    html = "<article>" + "".join(f"<p>{c * 5000}</p>" for c in "abcd") + "</article>"
    text = spark.createDataFrame([(html,)], "h string").select(pages.readable_text(F.col("h")).alias("x")).first().x
    assert len(text) == 15002 and text.endswith("c")
