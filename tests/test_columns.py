"""Exact values of column expressions on inline rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from newsiq.functions import dates, jsontext, social, text
from newsiq.operators import dedup


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://a.test/b//?UTM_anything", "http://a.test/b"),
        ("https://a.test/?k=2&utm_term=&j=1&gclid=9#", "https://a.test/?k=2&j=1"),
        ("https://a.test/b/index.htm?q=index.html", "https://a.test/b?q=index.html"),
        ("https://a.test/utm_path/x#y/z", "https://a.test/utm_path/x"),
        ("HTTPS://Example.COM:443/a/", "https://example.com/a"),
        ("http://example.com", "http://example.com/"),
        ("  not a url ", "not a url"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, url, text.canonical_url) == expected


def test_normalize_text(spark):
    assert one(spark, "READ MORE\t(a_b) 3.5% -- It's\n\nCookie policy; readmore", text.normalize_text) == "a b 3 5 its readmore"
    assert one(spark, "share this post, sign up for the newsletter... ", text.normalize_text) == ""
    assert one(spark, None, text.normalize_text) == ""


@pytest.mark.parametrize("raw", ["ﬁne ½ café Ⅳ ™ don’t naïve", "ａｂｃ straße ㎏ № ⑴", "中文 text 标题", "Ñandú éàç x²"])
def test_normalize_text_decomposes_like_nfkd(spark, raw):
    import re

    plain = unicodedata.normalize("NFKD", raw.lower()).replace("'", "").replace("’", "")
    expected = re.sub("[^a-zA-Z0-9一-鿿]+", " ", plain).strip()
    assert one(spark, raw, text.normalize_text) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("New GPU from X", True),
        ("the said AI", True),
        ("paint and chair", False),
        ("fine-tuning a model", True),
        ("o3-mini is out", True),
        ("国产大模型", True),
        ("deepseek", False),
        ("DeepSeek 发布", True),
        ("中文AI新闻", False),  # Han letters are word characters, as in the database
        (None, False),
    ],
)
def test_relevance(spark, raw, expected):
    assert one(spark, raw, text.is_ai_relevant) is expected


def test_usable_content(spark):
    body = "A dataset of tide gauges, the method in short, a benchmark of three models with 71% accuracy."
    rows = spark.createDataFrame(
        [
            ("Lab of Lindhaven publishes tide model", body, "2023-02-11"),
            ("", "Short announcement.", None),
        ],
        "t string, b string, d string",
    ).select(text.usable_content("t", "b", "d").alias("u")).collect()
    assert rows[0].u.usable_chars == len(body) and rows[1].u.usable_chars == len("Short announcement.")
    assert rows[0].u.technical_hits > 2 and rows[1].u.technical_hits == 0
    assert rows[0].u.score > rows[1].u.score


@pytest.mark.parametrize(
    "row,hint",
    [
        (("https://lab.example/research/tides", "Tide gauges compared", "A paper on gauges"), "research"),
        (("https://lab.example/notes/9", "Release notes of the gauge API", "What the API costs"), "product"),
        (("https://lab.example/notes/10", "Safety of the quay", "The safety rules"), "safety"),
    ],
)
def test_content_type_hint(spark, row, hint):
    df = spark.createDataFrame([row], "u string, t string, b string")
    assert df.select(text.content_type_hint("u", "t", "b")).first()[0] == hint


def test_fingerprint_ignores_tracking_and_punctuation(spark):
    base = ("http://a.test/p", "One two", "w " * 3000, "2020-01-01", "o")
    same = [("http://a.test/p/", "ONE... two", "W, " * 3000, "2020-01-01T23:59:00", "O"), ("http://a.test/p#f", "one two", "w " * 2500, "2020-01-01", "o")]  # 4000 characters count
    other = [("http://a.test/q", *base[1:]), (base[0], "One twO three", *base[2:]), (*base[:3], "2020-01-02", "o"), (*base[:4], "p"), (*base[:2], "w " * 100, *base[3:])]
    rows = spark.createDataFrame([(0, *base)] + [(1, *r) for r in same] + [(2, *r) for r in other], "n int, u string, t string, b string, d string, o string")
    prints = [(r.n, r.f) for r in rows.select("n", dedup.fingerprint("u", "t", "b", "d", "o").alias("f")).collect()]
    mine = next(f for n, f in prints if n == 0)
    assert all(len(f) == 64 and (f == mine) == (n < 2) for n, f in prints) and len({f for n, f in prints if n == 2}) == 5


@pytest.mark.parametrize(
    "url,key",
    [
        ("http://youtube.com/@a.B-c_9", "youtube:@a.b-c_9"),
        ("youtube.com/channel/UC" + "aB-_" * 6 + "?view=0", "youtube:channel:UC" + "aB-_" * 6),
        ("x?channel_id=UC" + "0" * 22 + "&n=1", "youtube:channel:UC" + "0" * 22),
        ("@Some.Handle", "youtube:@some.handle"),
        ("https://www.example.com/x/?a=1#b", "https://example.com/x"),
        ("", ""),
    ],
)
def test_social_key(spark, url, key):
    assert one(spark, url, social.social_key) == key


def test_channel_id_in_page_payload(spark):
    mine = "UC" + "z9" * 11
    assert one(spark, f'<i a="1">"externalId":"{mine}" ...', social.channel_id) == mine
    assert one(spark, f"<meta x itemprop='channelId' y content='{mine}'>", social.channel_id) == mine
    assert one(spark, '"externalId":"none"', social.channel_id) is None


def test_feed_candidates(spark):
    found = one(spark, "https://www.reddit.com/r/q.rss", social.feed_candidates)
    assert [u.removeprefix("https://").removesuffix(".rss") for u in found] == ["www.reddit.com/r/q", "old.reddit.com/r/q", "www.reddit.com/r/q/new/"]


@pytest.mark.parametrize(
    "raw,found",
    [
        ("[1] {} {2}", "{}"),
        ('} " {{"}":["{", 1]}, {}}{', '{{"}":["{", 1]}, {}}'),
        ('{"\\\\":"\\"}"} tail', '{"\\\\":"\\"}"}'),
        ('{"a": "\n\\', None),
        ("{" * 50 + "}" * 50 + "}", "{" * 50 + "}" * 50),
        ("東京 {" + "é" * 3000 + "} x", "{" + "é" * 3000 + "}"),
        ("", None),
        (None, None),
    ],
)
def test_first_json(spark, raw, found):
    assert one(spark, raw, jsontext.first_json) == found


@pytest.mark.parametrize(
    "raw,iso",
    [
        ("2026-05-28", "2026-05-28T00:00:00.000Z"),
        ("2026-05-28T01:02:03+02:00", "2026-05-27T23:02:03.000Z"),
        ("Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02T10:00:00.000Z"),
        ("Jan 5, 2024", "2024-01-05T00:00:00.000Z"),
        ("5 January 2024", "2024-01-05T00:00:00.000Z"),
        ("soon", "soon"),
        ("", None),
    ],
)
def test_dates(spark, raw, iso):
    assert one(spark, raw, dates.iso_or_text) == iso


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("abc", "xyz"), ("", "")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(text.trigram_similarity("a", "b")).collect()]
    assert got == [round(4 / 11, 6), 0.0, 0.0]


def test_registered_function(spark):
    text.register(spark)
    assert spark.sql("SELECT is_ai_relevant('an LLM'), is_ai_relevant('a chair')").first()[:] == (True, False)
