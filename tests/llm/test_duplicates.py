"""Near duplicates, embeddings, decontamination, components."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsiq.llm import decontam, embeddings, graph, minhash

DOCS = "doc_id long, text string, key string, id int, component_id string, kept string, n_shingles int"


def frame(spark, texts):
    rows = [(i, t, "k", 1, "c", "x", 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def reachable(n, links):
    root = list(range(n))
    for _ in range(n):
        low = list(root)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == root:
            break
        root = low
    return root


def words(rnd, n):
    return [rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(n)]


def variant(rnd, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"v{rnd.random()}"
    return out


def corpus():
    rnd, texts = random.Random(7), []
    for _ in range(8):
        base = words(rnd, rnd.randint(6, 200))
        texts += [" ".join(base), " ".join(base).upper(), "\t\n ".join(base)]
        texts += [" ".join(variant(rnd, base, k)) for k in (1, 2, 3, 5, 8)]
    chain = words(rnd, 100)  # a chain whose ends are not alike
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = chain[6:] + words(rnd, 6)
    passage = words(rnd, 60)  # one passage in otherwise different texts
    texts += [" ".join(words(rnd, 15) + passage + words(rnd, rnd.randint(0, 60))) for _ in range(25)]
    texts += [None, "", " \t", "one", "one", "ONE two", "one two three four", "a\xa0b c d e", "x " * 30_000, "y " * 30_000 + "z", "É é É é É é", "é é é é é é"]
    return texts


@pytest.mark.parametrize("chunk", [1024, 5])
def test_components_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    texts = corpus()
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reachable(len(texts), links)
    order = random.Random(1).sample(range(len(texts)), len(texts))
    df = frame(spark, [(i, texts[i]) for i in order] + [(3, texts[3]), (None, texts[0]), (None, None)])
    got = minhash.near_duplicates(df.repartition(4)).collect()
    assert len(got) == len(texts) + 3
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [known[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in known.values())
    assert [known[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = minhash.keep_representatives(df)
    assert kept.columns == df.columns and {r.key for r in kept.collect()} == {"k"}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [i for i, c in enumerate(want) if i == c] and ids.count(None) == 2


def test_one_id_with_two_texts_links_both(spark):
    rnd = random.Random(5)
    a, b = " ".join(words(rnd, 30)), " ".join(words(rnd, 30))
    got = minhash.near_duplicates(frame(spark, [(5, a), (5, b), (2, a), (9, b)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 2, 2: 2, 9: 2}


def test_empty_table(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_representatives(empty).collect() == []


def test_posterior_bound_against_integration():
    for n, least in minhash.least_matches(96):
        grid = (np.arange(200_000) + 0.5) / 200_000

        def tail(m):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            return p[grid >= 0.75].sum() / p.sum()

        assert tail(least) >= minhash.PRUNE_MISS > tail(least - 1)
    assert (1 - 0.75**minhash.ROWS) ** minhash.bands() <= minhash.BAND_MISS < (1 - 0.75**minhash.ROWS) ** (minhash.bands() - 1)


def test_signatures_estimate_similarity():
    rnd = random.Random(2)
    base = words(rnd, 400)
    a, b = minhash.shingles(pa.array([" ".join(base), " ".join(variant(rnd, base, 20))]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    seeds = minhash.mix(minhash.constants(2000, 11)).astype(np.uint32).reshape(-1, 2) | np.uint32(1)
    estimate = (minhash._minima(a, seeds) == minhash._minima(b, seeds)).mean()
    assert abs(estimate - exact) < 0.06


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(i, 300 + (i + 1) % 40) for i in range(300, 340)]
    ids = list(range(400))
    rnd.shuffle(ids)
    edges = [(ids[a], ids[b]) for a, b in edges] + [(7, 7)]
    want = reachable(400, edges)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for e in edges[:-1] for x in e}
    assert set(got) == ends and all(got[x] == want[x] for x in ends)


# ---------------------------------------------------------------- embeddings


def vectors():
    rng, rows = np.random.default_rng(3), []
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=8)
            rows += [(base + rng.normal(size=8) * s, label) for s in (0, 0.02, 0.05, 0.1, 0.2, 0.3)]
    hot = rng.normal(size=8)
    rows += [(hot + rng.normal(size=8) * 0.08, 1) for _ in range(80)] + [(hot, 1)] * 30 + [(hot, 0)] * 3
    step = rng.normal(size=(2, 8))
    rows += [(np.cos(t) * step[0] + np.sin(t) * step[1], 0) for t in np.arange(0, 2, 0.1)]  # a chain
    plain = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    nan, inf = float("nan"), float("inf")
    return plain + [(None, 0), ([0.0] * 8, 0), ([1.0, None] + [0.0] * 6, 0), ([nan] + [1.0] * 7, 0), ([inf] * 8, 1), ([1.0] * 8, None), ([2.0] * 8, None), ([1.0, 1.0], 1), ([2.0, 2.0], 1), ([], 1)]


@pytest.mark.parametrize(("per_cell", "chunk"), [(4096, 2048), (12, 2048), (12, 7)])
def test_links_against_all_pairs(spark, monkeypatch, per_cell, chunk):
    monkeypatch.setattr(embeddings, "PER_CELL", per_cell)
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = vectors()
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v) for v, label in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        (v, x), (w, y) = rows[a], rows[b]
        if ok[a] and ok[b] and x == y and len(v) == len(w):
            v, w = np.array(v), np.array(w)
            if v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((a, b))
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = reachable(len(rows), links)
    order = random.Random(1).sample(range(len(rows)), len(rows))
    df = spark.createDataFrame([(i, *rows[i], "x", 1, "y") for i in order] + [(None, rows[0][0], 0, "x", 1, "y")], "vec_id long, embedding array<float>, label int, home string, n int, dim string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df.repartition(3)).collect()}
    assert len(got) == len(rows) + 1 and (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert [got[i].n_links for i in range(len(rows))] == degree.tolist()
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(rows)))


def test_no_vectors_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(2, [1.0, 2.01], 0)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1)] * 3 + [(2, 3, 1)]


# ---------------------------------------------------------------- decontamination

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def overlap(doc, item):
    x, y = TOKEN.findall((doc or "").lower()), TOKEN.findall((item or "").lower())
    n = min(decontam.OVERLAP, len(y))
    if len(y) < decontam.SHORTEST:
        return False
    allowed = decontam.SUBSTITUTED * n // decontam.OVERLAP
    return any(sum(a != b for a, b in zip(x[i : i + n], y[j : j + n], strict=True)) <= allowed for i in range(len(x) - n + 1) for j in range(len(y) - n + 1))


def test_every_two_substitutions_are_found_by_a_mask():
    for wrong in itertools.combinations(range(decontam.OVERLAP), decontam.SUBSTITUTED):
        assert any(not any(o + p in wrong for p in picks) for picks in decontam._PICKS for o in range(decontam.OVERLAP - decontam._SPAN + 1))


def test_overlaps_against_all_alignments(spark):
    rnd = random.Random(11)
    items = [words(rnd, n) for n in (7, 8, 10, 13, 15, 20, 40, 3, 4, 5, 6, 9, 11, 12)]
    docs = [" ".join(words(rnd, 80)) for _ in range(6)]
    for item in items:
        for changes in (0, 1, 2, 3, 6):
            docs.append(" ".join(words(rnd, rnd.randint(0, 30)) + variant(rnd, item, changes) + words(rnd, rnd.randint(0, 30))))
        docs.append(", ".join(item).upper() + "!")
        docs.append(" ".join(item[: len(item) // 2] + words(rnd, 9)))
    docs += [None, "", "!!!", " ".join(items[6] * 3), "x " * 50_000]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, " - ".join(items[5]).upper()), (51, None), (52, ""), (None, " ".join(words(rnd, 20)))]
    docs.append(bench[-1][1])
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)] + [(8, docs[8], "x", 1), (None, " ".join(items[6]), "x", 1), (None, "clean text", "x", 1)], "doc_id long, text string, item_id string, start int")
    test = spark.createDataFrame([(i, t, "y") for i, t in bench], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(df.repartition(3), test).collect()}
    want = {(d, i) for d, t in enumerate(docs) for i, b in bench if i != 50 and overlap(t, b)}
    assert want <= got <= want | {(None, 6)} | {(None, i) for i in range(len(items)) if overlap(" ".join(items[6]), " ".join(items[i])) or overlap("clean text", " ".join(items[i]))} and (None, 6) in got
    kept = decontam.drop_contaminated(df, test)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert "clean text" in texts and " ".join(items[6]) not in texts and None in texts
    assert {t for t in docs if not any(overlap(t, b) for _, b in bench)} <= set(texts)
    assert decontam.overlaps(df.limit(0), test).collect() == [] and decontam.overlaps(df, test.limit(0)).collect() == []
    assert decontam.drop_contaminated(df, test.limit(0)).count() == df.count()


def test_copies_with_signs_and_marks_outside_ascii_are_found(spark):
    items = [
        "the reader’s guide says it’s “the town’s oldest bridge” and doesn’t name who’s built it or when they’re closing",
        "prices rose – slowly at first — then faster… and the bank’s report\u00a0said nothing of what came after that – or why",
        "हिन्दी में लिखा गया यह वाक्य परीक्षा के लिए है और इसमें कई मात्राएँ तथा संयुक्त अक्षर भी मिलते हैं",
        "le cafe\u0301 e\u0301tait ferme\u0301 hier soir et la re\u0301ponse du ge\u0301rant n’a pas e\u0301te\u0301 donne\u0301e a\u0300 temps",
        "今天，天气，很好，我们，一起，去，公园，散步，然后，回家，吃饭，看书，睡觉，明天，再来。",
    ]
    docs = [f"before that … {t} … and after" for t in items] + [" ".join(t.split()[::-1]) for t in items[:4]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    test = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(df, test).collect()) == [(i, i) for i in range(5)]


def test_copies_in_scripts_without_spaces_are_found(spark):
    items = ["今天天气很好我们一起去公园散步然后回家吃饭看书睡觉明天再来", "東京の天気は晴れです", "วันนี้อากาศดีมากเราจึงไปเดินเล่นที่สวนสาธารณะ", "where is the old mill"]
    docs = [f"前文{items[0]}后文", f"これは{items[1]}と言った", f"ก่อน{items[2]}หลัง", f"so where is the old mill, they asked", "今天我们不去公园", "東京は雨", "where is the new mill"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    test = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.overlaps(df, test).collect()) == [(i, i) for i in range(4)]
