"""Ranked search, alignment of tokenizers and repeated passages against brute force."""

import collections
import glob
import hashlib
import json
import math
import os
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from newsiq.llm import align, batches, hashing, lexical, queries, repeats

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
CLASH = "doc_id long, text string, item string, rank int, score string, block int, own string, kept string, spans int, found int, text_1 long, term long, n_a string, `odd.name` int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "i", 1, "s", 2, "o", "k", 3, 4, 5, 6, "n", 7) for i, t in texts], CLASH)


def vocabulary(seed, n=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


# ---------------------------------------------------------------- ranked search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    full = [c for _, c in counted if c]
    n_docs, total = len(full), sum(sum(c.values()) for c in full)
    df = collections.Counter(t for c in full for t in c)
    out = set()
    for item, text in set(items):
        asked, rows = collections.Counter(terms(text)), []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 75
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                rows.append((-s, i is not None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(rows)[:k], 1)}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_TERMS", 20)  # several packs of items
    rnd, words = random.Random(1), vocabulary(1)
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 40))).title()) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    docs += [(5, docs[5][1]), (None, docs[6][1]), (7001, None), (7002, ""), (7003, "?! ..."), (7004, "été ÉTÉ 東京 x9"), (7005, " ".join(rnd.choices(words, k=60_000)))]
    items = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 30)))) for i in range(12)]
    items += [(3, "東京 été"), (20, None), (21, ""), (22, "nowhere zzzz"), (None, words[0]), (0, items[0][1])]
    table = frame(spark, docs).repartition(5)
    index = lexical.build_index(table)
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 20)
    got = [tuple(r) for r in found.collect()]
    want = ranked(docs, items, 20)
    assert len(got) == len(set(got)) and {(i, r, s) for i, r, _, s in got} == {(i, r, s) for i, r, _, s in want}
    assert set(got) == want


def test_a_reader_holds_one_block_of_the_stored_index(spark, tmp_path):
    words = [f"w{i}" for i in range(1000)]
    docs = [(i, " ".join(words[i:] * (lexical.BLOCK_BYTES // 4500))) for i in range(3)]  # each a block
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "w0"), (8, "w1 w1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    place = batches.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    found = queries.op13_ranked_search(spark, str(tmp_path)).collect()
    assert {(r.item_id, r["rank"], r.doc_id) for r in found} == {(i, r, d) for i, r, d, _ in ranked(docs, [(7, "w0"), (8, "w1 w1")], 20)}
    files = [pq.ParquetFile(f) for n in set(os.listdir(place)) - before for f in glob.glob(f"{place}/{n}/*.parquet")]
    stored = [f.metadata for f in files if "dfs" in f.schema_arrow.names]
    assert [(m.num_rows, m.num_row_groups) for m in stored if m.num_rows] == [(3, 3)]


def test_terms_of_a_block_are_hashed_in_smaller_slices(monkeypatch):
    powers = [np.ones(1, np.uint64)] * 2
    monkeypatch.setattr(hashing, "_powers", powers)
    texts = [f"Ab{i % 7} cd, ef{i}" * 200 for i in range(2000)] + [None, "", "ab0"]
    found, row = lexical._terms(pa.array(["" if t is None else t for t in texts]))
    assert sum(map(len, texts[:2000])) > 4 * batches.SLICE_BYTES > 2 * len(powers[0])
    assert collections.Counter(row.tolist()) == {i: len(terms(t)) for i, t in enumerate(texts) if terms(t)}
    alone, _ = lexical._terms(pa.array(texts[1999:2000]))
    assert np.array_equal(alone, found[row == 1999])


def test_accumulators_stop_and_scores_stay_exact():
    rnd = np.random.default_rng(2)
    for trial in range(200):
        n, k = int(rnd.integers(1, 60)), int(rnd.integers(1, 8))
        postings = [np.sort(rnd.choice(n, rnd.integers(1, n + 1), replace=False)) for _ in range(6)]
        gains = [rnd.integers(0, 10 * 3 ** (6 - i), len(p)) for i, p in enumerate(postings)]
        full = np.zeros(n, np.int64)
        for g, p in zip(gains, postings, strict=True):
            full[p] += g
        floor = int(np.sort(full)[-min(k, n)]) if trial % 2 else 0
        at, scores = lexical.best_of_block(gains, [int(g.max()) for g in gains], postings, n, k, floor)
        least = max(1, floor, np.sort(full)[-k] if n >= k else 0)
        assert at.tolist() == np.flatnonzero(full >= least).tolist() and (scores == full[at]).all()


def test_search_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(some), items.where("false")).count() == 0
    assert lexical.search(lexical.build_index(some), items).columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- alignment

ODD = ["", None, " ", "  two  spaces ", "a▁b", "<s> [INST] </s><|endoftext|> <0x41> <unk>", "naïve café — “quoted” 東京 กรุงเทพ हिन्दी 🙂👍🏽", "a\x00b\x85c᠎ d\x1c", "é́", "\U000e0001", "tab\tand\nline\r\n\r\n  end", "x" * 3000, "1234567890" * 30, "﻿bom"]


def aligned(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align._byte_letters()
    names = {i: w for w, i in json.load(open(A))["model"]["vocab"].items()}
    counts, rows = collections.Counter(), []
    for text in texts:
        rows.append(None)
        if not text:
            continue
        ids = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        parts = [bytes(letters[c] for c in names[i]) if i != 50256 else b"" for i in ids[0]], [bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links = [(a, b) for i, a in enumerate(ids[0]) for j, b in enumerate(ids[1]) if ends[0][i] - len(parts[0][i]) < ends[1][j] and ends[1][j] - len(parts[1][j]) < ends[0][i]] if len(ids[0]) * len(ids[1]) < 10**6 else None
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids[s], ends[s], strict=True) if at < e <= cut) for s in (0, 1)))
            at = cut
        counts.update(links)
        rows[-1] = (len(ids[0]), len(ids[1]), groups, links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0,) * 6 + ("",) if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 2000)  # many blocks
    rnd, words = random.Random(3), vocabulary(3) + ["the", "Straße", "don't", "東京都", "2024", "—"]
    texts = ODD + [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(60)]
    texts += texts[20:23]
    docs = list(enumerate(texts))
    out = align.align(frame(spark, docs).repartition(3), A, B, public_tokenizers.PATTERN)
    assert "odd.name" in out.columns and "own" in out.columns
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    want = aligned(texts)
    assert len(got) == len(docs)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]


def test_alignment_of_empty_tables_and_null_ids(spark):
    assert align.align(frame(spark, []), A, B, public_tokenizers.PATTERN, keep=["doc_id"]).count() == 0
    rows = align.align(frame(spark, [(None, "a"), (None, "a"), (1, None)]), A, B, public_tokenizers.PATTERN, keep=["doc_id"]).collect()
    assert sorted((r.n_links, r.count_sum) for r in rows) == [(0, 0), (1, 2), (1, 2)]


def test_a_very_long_text_is_aligned_whole(spark):
    rnd, words = random.Random(4), vocabulary(4)
    text = " ".join(rnd.choices(words, k=400_000))
    row = align.align(frame(spark, [(1, text)]), A, B, public_tokenizers.PATTERN, keep=["doc_id"]).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 300_000


# ---------------------------------------------------------------- repeated passages


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((bytes(c for c, g in zip(x, gone, strict=False) if not g), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def passages(seed, alphabet="abcdefgh é"):
    rnd = random.Random(seed)

    def run(n):
        return "".join(rnd.choice(alphabet) for _ in range(n))

    shared = [run(n) for n in (30, 39, 40, 41, 45, 56, 57, 60, 90, 250)]
    texts = [run(rnd.randint(0, 60)) + "".join(rnd.choice(shared) + run(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 4))) for _ in range(150)]
    texts += [None, "", run(39), run(40), "a" * 39, "a" * 40, "a" * 41, "ab" * 60, "abc" * 50, texts[3], texts[3], texts[3], run(300)]
    return texts


def test_adding_up_needs_no_tokenizers_in_memory():
    files = SimpleNamespace(value=tuple(open(p, "rb").read() for p in (A, B)))
    align._loaded(files, public_tokenizers.PATTERN)
    assert "align" in batches._HELD
    links = align._pack(np.array([0, 1]), np.array([2, 1]), zstandard.ZstdCompressor())
    block = pa.table({"own": [1, None, None], "links": [links, None, None], "key": [None, 9, 4], "n": [None, 5, 7], "best": [None, True, False]})
    assert align._added_up(block, ["own", "n_best", "count_sum"]).to_pylist() == [{"own": 1, "n_best": 1, "count_sum": 19}]
    assert "align" not in batches._HELD



@pytest.mark.parametrize(("length", "hot"), [(40, 10_000), (40, 3), (24, 2), (41, 50), (200, 10_000), (200, 1)])
def test_repeats_equal_brute_force(spark, length, hot):
    texts = passages(length)
    if length == 200:
        texts = [(t or "") * 4 + (texts[i - 1] or "") * 3 for i, t in enumerate(texts)]
    want = without_repeats(texts, length)
    out = repeats.remove_repeats(frame(spark, enumerate(texts)).repartition(4), length=length, bits=16, hot=hot)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and "odd.name" in out.columns and "text_1" in out.columns
    for i, (kept, spans) in enumerate(want):
        r = got[i]
        assert (bytes(r.kept), [(s.start, s.end) for s in r.spans]) == (kept, spans), (i, texts[i])
        assert r.n_removed == sum(b - a for a, b in spans) and r.n_bytes == len((texts[i] or "").encode())


def test_repeats_across_the_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefgh") for _ in range(9000))
    texts = [text[:5000] + text[900:1300] + text[5000:], text[2990:3040] + "x" + text[3990:4031], "z" * 2500]
    want = without_repeats(texts, 40)
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(frame(spark, enumerate(texts)), length=40).collect()}
    assert [got[i] for i in range(3)] == [k for k, _ in want]


def test_repeats_of_empty_tables_null_ids_and_no_repeats(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    rows = repeats.remove_repeats(frame(spark, [(None, "q" * 30), (None, None), (1, "abc")]), length=24, keep=["doc_id"]).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (True, 0), (True, 30)]
    with pytest.raises(ValueError):
        repeats.remove_repeats(frame(spark, []), length=10)


def test_least_of_each_run():
    rnd = np.random.default_rng(5)
    for n, width in ((1, 1), (10, 3), (100, 17), (17, 17), (64, 8)):
        x = rnd.integers(0, 1000, n).astype(np.uint64)
        assert repeats._least(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]


def test_coalesce_groups_and_links():
    order, group, a, b, start = align.coalesce(np.array([2, 3, 1]), np.array([1, 4, 1]))
    assert list(zip(a.tolist(), b.tolist(), start.tolist(), strict=True)) == [(0, 0, 0), (0, 1, 1), (1, 1, 2), (2, 2, 5)]
    assert group[np.argsort(order)].tolist() == [0, 0, 1, 0, 0, 1]
    assert pa.array(order).sort().to_pylist() == list(range(6))
