"""Language, byte-level BPE, quality and token counts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsiq.llm import bpe, counts, langid, quality

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
CODEC = bpe.codec(bpe.load_ranks(open(RANKS, "rb").read()), P.PATTERN)
PIECES = [*"abZ'srt 019\n\t\r.,!?#éßñ日本語𝔘٣᠎　\x85\x1c​́\U0001F600½Ⅷ", "'s", "'re", "  ", "<|endoftext|>", "<|endo"]
ODD = [None, "", " ", "\n\n", "word", "it's <|endoftext|> here", "é" * 5000, "a b" * 30_000, "x" * 20_000, "!?" * 3000, "日本語" * 2000, "nul\x00l"]
DOCS = "doc_id long, text string, ids string, lang_pred int, n_tokens string, decoded int, log_weight string, lang string"


def docs(spark, texts):
    rows = [(i, t, "x", 1, "y", 2, "z", "en") for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None, None, None), (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), [r[1] or "" for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 16))
def test_tree_of_halves_gives_the_ids_of_the_whole(parts, leaf):
    text = "".join(parts)
    ids = bpe.encode_text(text, CODEC.encode_ordinary, leaf)
    assert ids == CODEC.encode_ordinary(text)
    assert bpe.decode_ids(ids, CODEC.decode_bytes, leaf) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 8))
def test_tree_on_any_characters(text, leaf):
    assert bpe.encode_text(text, CODEC.encode_ordinary, leaf) == CODEC.encode_ordinary(text)


def test_bpe_on_odd_rows(spark):
    df, texts = docs(spark, ODD)
    ids = bpe.encode(df, RANKS, P.PATTERN)
    assert ids.columns == [c for c in df.columns if c != "ids"] + ["ids"]
    rows = bpe.decode(ids, RANKS, P.PATTERN, keep=["doc_id", "ids"]).collect()
    want = sorted((CODEC.encode_ordinary(t), t.encode()) for t in texts)
    assert sorted((r.ids, bytes(r.decoded)) for r in rows) == want
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_token_counts_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK_ROWS", 4)
    df, texts = docs(spark, ODD)
    tokenizer = Tokenizer.from_file(JSON)
    want = sorted((len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts)
    got = counts.token_counts(df.repartition(2), JSON, P.PATTERN, parts=5).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 2
    assert counts.token_counts(df.limit(0), JSON, P.PATTERN).collect() == []


def test_parts_of_a_block_add_up_where_they_are_counted(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(40))) for i in range(20)], "doc_id long, text string").coalesce(1)
    sums, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *args: sums.append(self._df.where("sums IS NOT NULL").count()) or apply(self, *args))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        rows = counts.token_counts(df, JSON, P.PATTERN, parts=64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tokenizer = Tokenizer.from_file(JSON)
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: len(tokenizer.encode(r.text).ids) for r in df.collect()}
    assert sums == [counts.BUNCHES]  # one block, 64 parts, one task


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_pieces_of_pre_tokens_add_up(parts):
    text, tokenizer = "".join(parts), Tokenizer.from_file(JSON) if not hasattr(test_pieces_of_pre_tokens_add_up, "t") else test_pieces_of_pre_tokens_add_up.t
    test_pieces_of_pre_tokens_add_up.t = tokenizer
    split = counts._splitter(open(JSON, "rb").read(), P.PATTERN)
    assert sum(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in split(text)) == len(tokenizer.encode(text, add_special_tokens=False).ids)


# ---------------------------------------------------------------- language

VOCABULARY = langid.Vocabulary(open(RANKS, "rb").read())


def segmentations(word: bytes):
    if not word:
        yield []
    for k in range(1, min(langid.LONGEST, len(word)) + 1):
        if word[:k] in NUMBER:
            for rest in segmentations(word[k:]):
                yield [NUMBER[word[:k]], *rest]


NUMBER = {p: i for i, p in enumerate(VOCABULARY.pieces)}


def test_forward_and_expected_uses_against_all_segmentations():
    words = ["the", "stationing", "über", "日本", "a", "ations"]
    probs = np.random.default_rng(0).random((len(VOCABULARY.pieces) + 1, 2))
    probs[-1] = 0
    probs /= probs.sum(0)
    got, uses = np.zeros((len(words), 2)), np.zeros((len(VOCABULARY.pieces), 1))
    for pick, padded, lengths in langid._passes(pa.array(words)):
        lattice = VOCABULARY.lattice(padded, lengths)
        got[pick] = langid.forward(lattice, lengths, probs)
        langid.expected(lattice, lengths, probs[:, :1], np.ones((len(pick), 1)), uses)
    want = np.zeros(len(VOCABULARY.pieces))
    for i, word in enumerate(words):
        ways = list(segmentations(word.encode()))
        each = np.array([[np.prod(probs[w, k]) for k in (0, 1)] for w in ways])
        assert np.allclose(got[i], np.log(each.sum(0)), atol=1e-9)
        for way, p in zip(ways, each[:, 0] / each[:, 0].sum(), strict=True):
            for piece in way:
                want[piece] += p
    assert np.allclose(uses[:, 0], want, atol=1e-9)


def test_a_word_of_any_length_has_a_finite_probability():
    probs = np.vstack([np.full((len(VOCABULARY.pieces), 1), 1 / len(VOCABULARY.pieces)), [[0]]])
    for pick, padded, lengths in langid._passes(pa.array(["x" * 5000])):
        value = langid.forward(VOCABULARY.lattice(padded, lengths), lengths, probs)
    assert np.isfinite(value).all() and -60_000 < value[0, 0] < -1000


def test_languages_of_odd_rows(spark):
    rnd = random.Random(2)
    words = {"en": "the house and of river water with from".split(), "de": "der die das haus und fluss wasser mit".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=12)), lang) for i in range(60) for lang in words]
    train = spark.createDataFrame([*rows, (999, None, "en"), (998, "etwas", None)], "doc_id long, text string, lang string")
    model = langid.fit(train, RANKS)
    assert model.languages == ["de", "en"] and np.allclose(np.exp(model.log_probs).sum(0), 1)
    df, _ = docs(spark, ["The RIVER and the house", "das Wasser", None, "", "12 %% !", *ODD[3:]])
    got = {r.doc_id: r for r in langid.predict(df, model, RANKS).collect()}
    assert (got[0].lang_pred, got[1].lang_pred) == ("en", "de") and got[0].score > 0.9
    assert [(got[i].lang_pred, got[i].score) for i in (2, 4)] == [("und", 0.0)] * 2
    assert set(got[0].asDict()) == set(df.columns) | {"score"} and all(0 <= r.score <= 1 for r in got.values())
    empty = langid.fit(train.limit(0), RANKS)
    assert empty.languages == [] and {r.lang_pred for r in langid.predict(df, empty, RANKS).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, RANKS).collect() == []


def test_held_out_accuracy_on_the_fixture(spark):
    from newsiq import llm

    llm.load()
    sf = "/root/testdata/sf0.01"
    got = llm.QUERIES["op2_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


# ---------------------------------------------------------------- quality


def brute_weights(texts, targets):
    import math
    import re

    def grams(text):
        words = re.sub(r"([^\w\s]+)", r" \1 ", text.lower()).split()
        return [(w,) for w in words] + list(zip(words, words[1:], strict=False))

    raw, good = {}, {}
    for text, target in zip(texts, targets, strict=True):
        for g in grams(text):
            raw[g] = raw.get(g, 0) + 1
            good[g] = good.get(g, 0) + target
    n = quality.BUCKETS
    p, q = sum(good.values()) + n, sum(raw.values()) + n
    return [sum(math.log((good[g] + 1) / p) - math.log((raw[g] + 1) / q) for g in grams(t)) for t in texts]


def test_weights_are_log_ratios_of_the_two_models(spark):
    texts = ["alpha beta gamma", "alpha, beta!", "### $$$ alpha", "", "beta beta beta"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    sample = quality.sample_labels(labels)
    model = quality.fit(df, sample)
    got = {r.doc_id: r.log_weight for r in quality.weigh(df, model).collect()}
    want = brute_weights(texts, [1, 1, 0, 0, 0])
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-5)
    assert quality.sample_labels(labels, most=2).count() == 2


@pytest.mark.parametrize("k", [1, 2, 7, 40, 100])
def test_kth_largest(spark, k):
    rnd = random.Random(k)
    values = [rnd.randint(-(2**62), 2**62) for _ in range(60)] + [5] * 30 + [-1] * 10
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


def test_selection_keeps_good_rows_and_is_reproducible(spark):
    rnd = random.Random(3)
    good = [" ".join(rnd.choices("one two three four five six".split(), k=20)) for _ in range(80)]
    bad = [" ".join(rnd.choices("| %% ## two".split(), k=20)) for _ in range(20)]
    texts = good + bad
    rows = [(i, t, "a", 1, "b", 1, "own", "en") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "a", 1, "b", 1, "own", "en"), (None, None, None, None, None, None, "own", None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 100, 2)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    chosen = quality.select(df, labels)
    kept = quality.keep_selected(df, chosen)
    assert kept.columns == df.columns and {r.log_weight for r in kept.collect()} == {"own"}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(80) if i != 4} <= set(ids) and not set(range(80, 100)) & set(ids) and ids.count(5) == 2
    ten = quality.select(df, labels, k=10)
    assert 10 <= quality.keep_selected(df, ten).count() <= 11
    assert sorted(map(str, quality.keep_selected(df.repartition(3), ten).collect())) == sorted(map(str, quality.keep_selected(df, ten).collect()))
    assert quality.keep_selected(df.limit(0), quality.select(df.limit(0), labels)).collect() == []
    assert quality.select(df, labels.limit(0)).k == len(rows)


def test_toxic_passages_go_and_clean_texts_stay_whatever_the_length(spark):
    rnd = random.Random(8)
    common, rare, marks = [f"w{i}" for i in range(300)], [f"r{i}" for i in range(30_000)], [f"bad{i}" for i in range(10)]
    texts = []
    for i in range(1500):
        text = rnd.choices(common, k=rnd.choice((40, 150, 600))) + rnd.choices(rare, k=20)
        rnd.shuffle(text)
        if i % 10 == 9:
            at = rnd.randrange(len(text))
            text[at:at] = rnd.choices(marks, k=4)
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 9)) for i in range(1500) if i % 3], "doc_id long, quality int, toxic int")
    chosen = quality.select(df, labels)
    assert len(chosen.model.log_ratio) > quality.BUCKETS
    kept = {r.doc_id for r in quality.keep_selected(df, chosen).collect()}
    assert len(kept & set(range(9, 1500, 10))) <= 5
    assert len([i for i in range(1500) if i % 10 < 9 and i not in kept]) <= 20


def test_labelled_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.keep_selected(docs, quality.select(docs, labels)).join(labels, "doc_id").groupBy("quality", "toxic", F.expr("lang = 'en'").alias("en")).count().collect()
    n = {(r.quality, r.toxic, r.en): r["count"] for r in rows}
    clean = labels.where("quality = 1 and toxic = 0").count()
    assert n[1, 0, True] + n[1, 0, False] >= 0.99 * clean
    assert n.get((1, 1, True), 0) <= 0.15 * 242  # the insults are English words


def test_digests_of_the_registered_query(spark):
    from newsiq import llm

    llm.load()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in llm.QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = CODEC.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
