"""Chat windows, the registered queries and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from compare import connect, diff
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from newsiq import llm
from newsiq.llm import chat

RANKS = P.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
llm.load()
PARTS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", ">", "[", "end", "<|end|>\n", "\n", "a", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.lists(st.sampled_from(PARTS), max_size=6))
def test_escape_is_reversible_and_leaves_no_control_string(text, role):
    text, role = "".join(text), "".join(role)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.parse(chat.turn(role, text) + chat.turn(text, role)) == [(role, text), (text, role)]


def test_forged_windows_are_errors():
    with pytest.raises(ValueError, match="not a formatted window"):
        chat.parse(chat.turn("user", "a") + "rest")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(0, 20), st.integers(0, 30), st.integers(0, 20))
def test_windows_cover_new_turns_once_within_budget(sizes, first, history, system):
    budget, first = 60, min(first, len(sizes))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    spans = list(chat.windows_of(begins, ends, first, system, budget, history))
    assert [k for _, i, e in spans for k in range(i, e)] == list(range(first, len(sizes)))
    for j, i, e in spans:
        assert j <= i < e and begins[i] - begins[j] <= history
        assert system + ends[e - 1] - begins[j] <= budget or (e == i + 1 and j == i)


def conversations():
    rnd, rows = random.Random(3), []
    for conv in range(12):
        n = 300 if conv == 5 else rnd.randint(1, 12)
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "be brief"))
        rows += [(conv, k + 1, "user" if k % 2 == 0 else "assistant", "w " * rnd.randint(0, 60) + rnd.choice(PARTS)) for k in range(n)]
    rows += [(20, 0, "system", "alone"), (21, 0, "assistant", None), (21, 1, None, "x"), (22, None, "user", "null turn"), (22, 1, "assistant", "y " * 9000)]
    rows += [(23, 1, "user", "tie b"), (23, 1, "user", "tie a"), (23, 1, "assistant", "tie"), (23, 2, "user", "again"), (23, 2, "user", "again")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id either"), (24, 0, "user", ""), (24, 1, "system", "late")]
    return rows


@pytest.mark.parametrize(("budget", "history", "block"), [(1024, 256, 32), (120, 60, 2)])
def test_windows_give_the_turns_back(spark, monkeypatch, budget, history, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, block string, pos int, n_tokens string")
    windows = chat.format_windows(df.repartition(5), RANKS, P.PATTERN, budget, history)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    out = windows.collect()
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (found.n_turns, found.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest()), conv
        assert (found.loss_chars, found.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
        mine = sorted((w for w in out if w.conv_id == conv), key=lambda w: (w.block, w.window))
        assert found.formatted_chars == sum(len(w.text) for w in mine)
        system = (turns[0][2], turns[0][3]) if turns[0][2] == "system" else None
        for n, w in enumerate(mine):
            assert w.over_budget == (w.n_tokens > budget)
            if system:
                assert chat.parse(w.text)[0] == system and w.turns[0].repeated == (n > 0)
    assert any(t.repeated for w in out for t in w.turns)
    assert chat.digests(chat.format_windows(df.limit(0), RANKS, P.PATTERN)).collect() == []


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    assert diff(llm.QUERIES[name](spark, SMALL), connect(SMALL), llm.ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "!!! 123", None, None, None), (None, "this is the text of one without an id", "en", "s", 1)], docs.schema)
    before = docs.unionByName(junk).selectExpr("*", "'x' AS lang_pred", "'y' AS score", "'z' AS rank_key", "'w' AS kept")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == before.columns
        rows = after.collect()
        assert {(r.lang_pred, r.score, r.rank_key, r.kept) for r in rows} == {("x", "y", "z", "w")}
        kept[name] = {r.doc_id for r in rows}
        before = spark.createDataFrame(rows, before.schema)
    sizes = [len(v) for v in kept.values()]
    assert sizes == sorted(sizes, reverse=True) and not {-1, -2} & kept["language"] and None in kept["language"]
    out = corpus_pipeline.tokenised(spark, before, SMALL).collect()
    assert {r.doc_id for r in out} == kept["decontamination"] and all(r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_columns_with_the_names_of_helpers(spark):
    helpers = ["_draw", "_gone", "_row", "_again", "_other_id", "_bad_id", "_bad_hash", "_own_score", "lang_pred", "per_byte", "score", "_label_id", "log_weight", "_own_log_weight", "n_shingles", "hash"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", *[f"'{c}' AS `{c}`" for c in helpers])
    docs = docs.unionByName(docs.limit(3)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert rows and all(r[c] == c for r in rows for c in helpers), name


def test_language_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, "".join(chr(0x10400 + (i * 7) % 80) for i in range(200)), None, None, None), (-2, "\n", None, None, None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), SMALL).collect()}
    assert not {-1, -2} & kept
    assert {r.doc_id for r in docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'").collect()} <= kept
    unlabelled = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, unlabelled, SMALL).collect()}
    assert -1 in kept and -2 not in kept


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, corpus_pipeline.language(spark, docs, ""), "/root/testdata/sf0.01").select("doc_id")
    good, bad = (labels.where(f"quality = {q}") for q in (1, 0))
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert bad.join(kept, "doc_id").count() <= 0.15 * bad.count()
