"""Search and duplicate joins against brute force, with hot groups and skew."""

import glob
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsiq.operators import dedup
from newsiq.operators.knn import knn_join
from newsiq.operators.lineage import shared_folder
import __spark_entry__ as spark_entry
from newsiq.operators import retrieval, termindex
from newsiq.operators.termindex import best_matches, term_matches


def knn_brute(q, c, k):
    out = set()
    for qi, qv in q:
        s = sorted(
            ((-round(float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v))), 9), i) for i, v in c),
        )[:k]
        out |= {(qi, i, r) for r, (_, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_knn_with_a_third_of_equal_vectors(spark, block):
    rng = np.random.default_rng(1)
    corpus = [(i, rng.normal(size=8)) for i in range(400)]
    same = corpus[0][1]
    corpus += [(1000 + i, same) for i in range(200)]
    queries = [(i, rng.normal(size=8)) for i in range(9)] + [(9, same)]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in corpus] + [(5000, None)], "id long, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id long, query_embedding array<double>")
    got = {(r.query_id, r.id, r["rank"]) for r in knn_join(q, c, 12, block_queries=block, block_rows=90).collect()}
    assert got == knn_brute(queries, corpus, 12)


def test_knn_with_string_keys_and_no_job_while_planning(spark):
    rng = np.random.default_rng(2)
    name = lambda i: f"{i * 7919 % 1000:08x}-aaaa"
    corpus, queries = [(name(i), rng.normal(size=4)) for i in range(300)], [(f"q-{i}", rng.normal(size=4)) for i in range(5)]
    c = spark.createDataFrame([(i, v.tolist(), "a" + i, 7) for i, v in corpus], "id string, embedding array<double>, article string, n int").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id string, query_embedding array<double>")
    tracker, group = spark.sparkContext.statusTracker(), "planning only"
    spark.sparkContext.setJobGroup(group, group)
    found = knn_join(q, c, 6, carry=["article", "n"])
    assert tracker.getJobIdsForGroup(group) == []
    spark.sparkContext.setJobGroup("run", "run")
    rows = found.collect()
    assert {(r.query_id, r.id, r["rank"]) for r in rows} == knn_brute(queries, corpus, 6)
    assert all(r.article == "a" + r.id and r.n == 7 for r in rows)


def test_knn_holds_more_query_blocks_than_it_may(spark, monkeypatch):
    from newsiq.operators import knn

    monkeypatch.setattr(knn, "HELD", 1)
    rng = np.random.default_rng(4)
    corpus, queries = ([(i, rng.normal(size=6)) for i in range(n)] for n in (500, 23))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in corpus], "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id long, query_embedding array<double>")
    for threshold in ("10MB", "-1"):  # also as a product of partitions, which reads the corpus once
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = knn_join(q, c, 5, block_queries=2, block_rows=40)
            assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == knn_brute(queries, corpus, 5)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_vector_index_is_exact_and_probing_reaches_its_recall(spark, spread):
    from newsiq.operators import vectorindex

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 3
    corpus = [(f"v{i:04d}", centres[0 if i % 3 == 0 else i % 12] + spread * rng.normal(size=8)) for i in range(900)]  # a third in one cell
    corpus += [(f"w{i}", corpus[0][1]) for i in range(30)] + [("zero", np.zeros(8))]
    queries = [(i, centres[i % 12] + spread * rng.normal(size=8)) for i in range(40)] + [(99, corpus[0][1])]
    c = spark.createDataFrame([(i, v.tolist(), len(i)) for i, v in corpus] + [("null", None, 1)], "id string, embedding array<double>, n int").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries] + [(100, None)], "query_id long, query_embedding array<double>")
    index = vectorindex.build(c, carry=["n"])
    found = vectorindex.search(index, q, 7, block_queries=6)
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == knn_brute(queries, corpus[:-1], 7)
    assert all(r.n == len(r.id) for r in found.collect())
    probes = vectorindex.probes_for(index, q, 7, 0.9)
    some = vectorindex.search(index, q, 7, probes=probes)
    hit = some.join(found, ["query_id", "id"], "left_semi").count()
    assert hit >= 0.9 * found.count() and probes >= 1
    empty = vectorindex.build(c.limit(0))
    assert vectorindex.search(empty, q, 3).count() == 0


def test_knn_edges(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_embedding array<double>")
    assert [(r.id, r.score) for r in knn_join(q, c, 0).collect()] == [(1, 0.0)]
    assert knn_join(q.limit(0), c, 3).count() == 0 and knn_join(q, c.limit(0), 3).count() == 0


@pytest.mark.parametrize("partitions", [None, 3])
def test_substring_join(spark, partitions):
    rnd = random.Random(3)
    words = ["ab", "abc", "bcd", "the", "xyz", "zz top", "q"]
    texts = [(f"id-{i}", " ".join(rnd.choice(words) for _ in range(6)).upper(), rnd.choice(words + [None])) for i in range(200)]
    terms = ["ab", "bc", "the", "zz", "top x", "nope", "xyz the"]
    t = spark.createDataFrame(texts, "id string, a string, b string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    weights = {"a": 4.0, "b": 2.0}
    got = {(r.id, r.term): r.score for r in term_matches(t, w, "id", ["a", "b"], weights, partitions=partitions).collect()}
    assert set(got) == {(i, x) for i, a, b in texts for x in terms if x in a.lower() or x in (b or "").lower()}
    queries = [("q1", "ab"), ("q1", "the"), ("q2", "zz"), ("q3", "nope")]
    best = best_matches(t, spark.createDataFrame(queries, "query_id string, term string"), "id", weights, 500, 9, partitions).collect()
    want = {}
    for q, x in queries:
        for (i, term), score in got.items():
            if term == x:
                want[(q, i)] = want.get((q, i), 0.0) + score
    assert {(r.query_id, r.id): r.score for r in best} == {key: round(v, 9) for key, v in want.items() if round(v, 9) > 0}


def test_terms_of_several_words_signs_and_parts_of_words(spark):
    texts = [(1, "C++ and c# (x--y)", None), (2, "the OPEN source-code", "++"), (3, "", None), (4, None, None), (5, "naïve 東京都 a1b2", "open  source"), (6, "x--", "a1")]
    terms = ["c++", "++", "--y", "open source", "open", "pen s", "京都", "aïv", "1b", "e s", "source-code", "zz", "n", "--"]
    t = spark.createDataFrame(texts, "id long, a string, b string")
    got = {(r.id, r.term) for r in term_matches(t, spark.createDataFrame([(x,) for x in terms], "term string"), "id", ["a", "b"]).collect()}
    assert got == {(i, x) for i, a, b in texts for x in terms if x in (a or "").lower() or x in (b or "").lower()}


def test_best_texts_are_exact_where_bounds_prune(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6))), " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(300)]
    texts += [(1000 + i, texts[7][1], texts[7][2]) for i in range(20)]  # ties
    queries = [(q, w) for q in range(12) for w in {rnd.choice(words) for _ in range(6)} if len(w) > 1]
    weights = {"a": 4.0, "b": 2.0}
    t, w = spark.createDataFrame(texts, "id long, a string, b string"), spark.createDataFrame(queries, "query_id int, term string")
    every = {(r.id, r.term): r.score for r in term_matches(t, w.select("term").distinct(), "id", ["a", "b"], weights).collect()}
    for k in (1, 7, 400):
        want = set()
        for q in {q for q, _ in queries}:
            sums = {}
            for term in [x for y, x in queries if y == q]:
                for i, _, _ in texts:
                    if (i, term) in every:
                        sums[i] = sums.get(i, 0.0) + every[(i, term)]
            rows = sorted((-round(s, 9), i) for i, s in sums.items() if round(s, 9) > 0)[:k]
            want |= {(q, i, -s, n) for n, (s, i) in enumerate(rows, 1)}
        got = {(r.query_id, r.id, r.score, r["rank"]) for r in best_matches(t, w, "id", weights, k, 9, plain=True).collect()}
        assert got == want


def test_search_plans_have_no_python(spark):
    t = spark.createDataFrame([(1, "a b", "c")], "id long, a string, b string")
    w = spark.createDataFrame([(1, "a")], "query_id long, term string")
    plan = best_matches(t, w, "id", {"a": 4.0, "b": 2.0}, 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "CartesianProduct", "NestedLoop"))


def test_lexical_lists_carry_numbers_and_no_hits(spark, monkeypatch):
    written, real = [], termindex.cut
    monkeypatch.setattr(termindex, "cut", lambda df: written.append(df.columns) or real(df))
    t = spark.createDataFrame([(1, "red apple", "an apple is red"), (2, "green pear", "no apple")], "id long, a string, b string")
    w = spark.createDataFrame([(1, "apple"), (1, "pear"), (2, "red")], "query_id long, term string")
    rows = best_matches(t, w, "id", {"a": 4.0, "b": 2.0}, 2, 9, plain=True).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in sorted(rows)] == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    assert ["no", "own"] in written and ["id", "no", "first", "most"] in written and ["query_id", "id", "sure", "most"] in written


def test_best_texts_write_only_pairs_that_can_win(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    texts = [(i, " ".join(rnd.choices(words, k=9)), " ".join(rnd.choices(words, k=rnd.choice([3, 90, 120])))) for i in range(600)]
    texts += [(700, texts[0][1], texts[1][2] + " zyxzyx𝒜bc"), (701, None, texts[2][2]), (702, "", None), (703, texts[4][1], texts[4][2] + " " + "k" * 3000)]
    queries = [(q, w) for q in range(20) for w in set(texts[q * 7][1].split()[:6])] + [(50, "zyx"), (50, words[0]), (51, "zyxzyx𝒜b"), (52, "nowhere")]
    written, real = {}, termindex.cut

    def cut(df):
        out = real(df)
        written[",".join(df.columns)] = out
        return out

    monkeypatch.setattr(termindex, "cut", cut)
    t, w = spark.createDataFrame(texts, "id long, a string, b string"), spark.createDataFrame(queries, "query_id int, term string")
    got = {(r.query_id, r.id, r.score, r["rank"]) for r in best_matches(t, w, "id", {"a": 4.0, "b": 2.0}, 5, 9, plain=True).collect()}

    def grams(x):
        return {f"  {v} "[i : i + 3] for v in re.findall(r"[^\W_]+", x) for i in range(len(v) + 1)}

    want, met, sets = set(), 0, {i: [(x, grams(x), y) for x, y in ((a or "", 4.0), (b or "", 2.0))] for i, a, b in texts}
    for q in {q for q, _ in queries}:
        sums = {}
        for term in [x for y, x in queries if y == q]:
            own = grams(term)
            for i, fields in sets.items():
                if any(term in x for x, _, _ in fields):
                    sums[i] = sums.get(i, 0.0) + max(y * len(own & g) / len(own | g) for _, g, y in fields)
        met += len(sums)
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted((-round(s, 9), i) for i, s in sums.items() if round(s, 9) > 0)[:5], 1)}
    assert got == want
    long = {i for i, _, b in texts if b and len(b) > 400}
    rows = [r for r in written["query_id,id,sure,most"].where("query_id < 20").collect() if r.id in long]
    assert len({(r.query_id, r.id) for r in rows}) < met / 4  # before, every text with a term was written


def test_substring_join_says_that_its_terms_are_plain(spark, monkeypatch):
    plans, real = [], termindex._found
    monkeypatch.setattr(termindex, "_found", lambda *args: plans.append(args[-1]) or real(*args))
    assert spark_entry.queries()["joi_7_substring_join"](spark, "/root/testdata/sf0.001").count() > 0
    assert plans == [True]  # plain terms need no second look at the texts


@pytest.mark.parametrize("name", ["ret_5_rrf", "ret_7_lexical", "ret_7_hybrid", "ret_7_chunk_hybrid", "ret_7_entity_hybrid", "ret_7_rerank_hybrid", "evl_5_candidates_for_labeling"])
def test_lexical_lists_spread_tables_of_few_blocks(spark, monkeypatch, name):
    asked = []

    def best(texts, terms, id_col, weights, k, digits, partitions=None, plain=False):
        asked.append((partitions, plain))
        return spark.createDataFrame([], "query_id long, article_id long, score double, rank int")

    monkeypatch.setattr(retrieval, "best_matches", best)
    spark.conf.set("spark.newsiq.partitions", "3")
    try:
        spark_entry.queries()[name](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.newsiq.partitions")
    assert asked == [(3, True)]


def make_items(seed, hot):
    """Random articles, exact copies, near copies, shared boilerplate and repeated URLs."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    boiler = " ".join(f"foot{i}" for i in range(12))
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 60))] for _ in range(40)]
    rows = []
    for i in range(150):
        body = list(rnd.choice(base))
        if rnd.random() < 0.5 and len(body) > 30:
            body[rnd.randrange(len(body))] = rnd.choice(vocab)
        title = " ".join(body[:6])
        text = " ".join(body) + (" " + boiler if rnd.random() < 0.5 else "")
        rows.append((i, f"https://x/{i if rnd.random() < 0.9 else i // 7}", title, text, f"2024-01-{1 + i % 2:02d}", rnd.choice(["official", "secondary"]), rnd.choice([0, 100])))
    rows += [(1000 + i, f"https://y/{i}", "hot title of many copies", "one hot body " * 20, "2024-01-01", "secondary", 0) for i in range(hot)]
    rows += [(3000 + i, f"https://z/{i}", "another hot title here", "near copy number " * 15 + f"n{i}", "2024-01-01", "official", 1) for i in range(hot // 2)]
    rows += [(5000, "https://e/1", "", "", None, "official", 0), (5001, "https://e/2", "", "", None, "official", 0)]
    return rows


def brute(rows):
    """All pairs by the definition."""
    import re

    def norm(s):
        return re.sub("[^a-z0-9]+", " ", s.lower()).strip()

    def shingles(s):
        w = s.split()
        return {" ".join(w)} if 0 < len(w) <= 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    def jac(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    sig = {r[0]: (r[1], set(norm(r[2]).split()), shingles(norm(r[3])), (r[4] or "")[:10]) for r in rows}
    pairs = {}
    ids = sorted(sig)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sig[a], sig[b]
            s = 1.0 if x[0] == y[0] else min(1.0, 0.38 * jac(x[1], y[1]) + 0.59 * jac(x[2], y[2]) + (0.03 if x[3] and x[3] == y[3] else 0))
            if s >= 0.9:
                pairs[(a, b)] = pairs[(b, a)] = s
    rank = {r[0]: (r[5] == "official", r[6], len(re.sub(r"\s+", " ", r[3]).strip()), -r[0]) for r in rows}
    return pairs, rank


SCHEMA = "id long, url string, title string, body string, published_at string, trust_tier string, dedupe_priority int"


@pytest.mark.parametrize("seed,hot", [(1, 20), (2, 200)])
def test_duplicates_match_brute_force(spark, seed, hot):
    rows = make_items(seed, hot)
    pairs, rank = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    best = {}
    for a, b in pairs:
        best[a] = max(best.get(a, (rank[b], b)), (rank[b], b))
    got = {r.id: (r.partner_id, round(r.similarity, 9)) for r in dedup.similar_pairs(df).collect()}
    assert got == {a: (b, round(pairs[(a, b)], 9)) for a, (_, b) in best.items()}
    # in-batch: official items only
    official = {r[0] for r in rows if r[5] == "official"}
    lost = {a for a, b in pairs if a in official and b in official and rank[b] > rank[a]}
    assert {r.id for r in dedup.suppress_batch(df).collect()} == lost
    parent = {i: i for i in official}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a in official and b in official:
            parent[find(a)] = find(b)
    groups = {}
    for i in official:
        groups.setdefault(find(i), []).append(i)
    dropped = {i: max(g, key=lambda x: rank[x]) for g in groups.values() for i in g if i != max(g, key=lambda x: rank[x])}
    assert {r.id: r.winner_id for r in dedup.suppress_batch(df, mode="cluster").collect()} == dropped


def test_suppress_against_existing(spark):
    rows = make_items(5, 30)
    pairs, rank = brute(rows)
    cands = {r[0] for r in rows if r[0] % 2}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.winner_id for r in dedup.suppress(df.where("id % 2 = 1"), df.where("id % 2 = 0")).collect()}
    best = {}
    for a, b in pairs:
        if a in cands and b not in cands:
            best[a] = max(best.get(a, (rank[b], b)), (rank[b], b))
    assert got == {a: b for a, (r, b) in best.items() if r[:3] > rank[a][:3]}


def test_official_wins(spark):
    body = "The harbour authority of Lindhaven opens the northern quay for ferries and small cargo ships from Monday on."
    rows = [
        (1, "https://lindhaven.example/notices/quay", "Lindhaven opens the northern quay for ferries and cargo ships", body, "2023-02-11", "official", 100),
        (2, "https://paper.example/lindhaven-quay", "Lindhaven opens northern quay for ferries and cargo ships", body, "2023-02-11", "secondary", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = dedup.suppress(df.where("id = 2"), df.where("id = 1")).first()
    assert (got.id, got.winner_id, got.reason) == (2, 1, "official_beats_secondary") and got.similarity >= 0.9
    assert dedup.suppress(df.where("id = 1"), df.where("id = 2")).count() == 0


def test_components_on_a_long_chain(spark):
    n = 300
    nodes = spark.range(n + 2).select("id")
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.component for r in dedup.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, n + 1: n + 1}


def test_hard_negatives_in_blocks(spark, monkeypatch):
    from newsiq.operators import mining
    from newsiq.plans import evalset

    rnd = random.Random(4)
    words = [f"word{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    day = lambda: f"2024-01-{rnd.randint(1, 9):02d}"
    news = spark.createDataFrame(
        [(i, i % 4 if i % 9 else None, rnd.choice(["a", "b", "c"]), day() if i % 5 else None, day(), None, None, text(5), None, text(8)) for i in range(300)],
        "id long, source_id long, category string, published_at string, created_at string, title string, title_en string, title_zh string, summary_en string, summary_zh string",
    ).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "created_at")})
    cases = spark.createDataFrame([(c, text(4), c * 3, [rnd.choice(words)] if c % 2 else []) for c in range(12)], "case_id long, question string, primary_article_id long, entity_tags array<string>")
    gold = spark.createDataFrame([(c, rnd.randrange(300), rnd.randint(0, 3), "approved", None) for c in range(12) for _ in range(4)], "case_id long, article_id long, relevance_grade int, review_status string, evidence_role string").dropDuplicates(["case_id", "article_id"])
    found = spark.createDataFrame([(c, rnd.randrange(300), r) for c in range(12) for r in range(1, 26)], "case_id long, article_id long, rank int")
    one = {tuple(sorted(r.asDict().items())) for r in evalset.hard_negatives(cases, gold, news, found, 6).collect()}
    monkeypatch.setattr(mining, "BLOCK_CASES", 3)
    monkeypatch.setattr(mining, "BLOCK_ROWS", 20)
    many = {tuple(sorted(r.asDict().items())) for r in evalset.hard_negatives(cases, gold, news.repartition(3), found, 6).collect()}
    assert one == many and len(one) > 40


def test_skew_join_splits_hot_keys(spark):
    from newsiq.operators.joins import skew_join

    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(tuple(r) for r in big.join(small, "k").collect())
    split = skew_join(big, small, "k", salts=4)
    assert sorted(tuple(r) for r in split.collect()) == want and split.columns == ["k", "id", "v"]
    parts = big.where("k = 0").select(F.pmod(F.xxhash64("k", "id"), F.lit(4)).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 500


def test_quantiles_equal_sorted_lists(spark):
    import math

    from newsiq.operators.quantiles import quantiles

    rnd = random.Random(12)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0, 0, 0, rnd.randint(-50, 50), 10**9 + 7])) for _ in range(600)]
    rows += [("one", 5), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    ps = (0.0, 0.05, 0.5, 0.95, 1.0)
    wanted = {f"{k}{i}": ("x", p, k) for i, p in enumerate(ps) for k in ("cont", "disc")}
    for by in (["g"], []):
        for parts in (1, 7):
            got = {r.g if by else 0: r for r in quantiles(df, by, wanted, parts).collect()}
            assert set(got) == ({g for g, _ in rows} if by else {0})
            for g, r in got.items():
                v = sorted(x for h, x in rows if x is not None and (not by or h == g))
                for i, p in enumerate(ps):
                    at = p * (len(v) - 1)
                    want = (v[math.floor(at)] * (1 - at % 1) + v[math.ceil(at)] * (at % 1), v[max(1, math.ceil(p * len(v))) - 1]) if v else (None, None)
                    assert (r[f"cont{i}"], r[f"disc{i}"]) == pytest.approx(want) if v else (r[f"cont{i}"], r[f"disc{i}"]) == want
    assert quantiles(df.limit(0), ["g"], wanted).count() == 0
    assert quantiles(df.limit(0), [], wanted).first().cont0 is None
    plan = quantiles(df, ["g"], wanted)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_or_join_as_classes_gives_every_pair_once(spark):
    from newsiq.operators.joins import or_of_keys

    rnd = random.Random(4)
    right = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice(["x", "y", None])) for i in range(80)]
    left = [(100 + i, rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", None])) for i in range(12)]
    listed = [(100 + rnd.randrange(13), rnd.randrange(90)) for _ in range(60)]
    r, w = spark.createDataFrame(right, "r long, a int, b string"), spark.createDataFrame(left, "l long, a int, b string")
    links, outside = or_of_keys(w, r, "l", "r", ["a", "b"], spark.createDataFrame(listed, "l long, r long"))
    pairs = [(x.l, y[0]) for x in links.collect() for y in right if x.a is not None and x.b is not None and (x.a, x.b) == y[1:]]
    assert {x.l: x.members for x in links.collect()} == {i: sum(p[0] == i for p in pairs) for i, _, _ in left}
    pairs += [(x.l, x.r) for x in outside.collect()]
    want = {(x[0], y[0]) for x in left for y in right if (None not in x and x[1:] == y[1:]) or (x[0], y[0]) in listed}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_near_duplicates_store_less_than_the_texts(spark):
    """Neither sets of shingles nor second copies of the signatures are written."""
    rnd = random.Random(7)
    bodies = [" ".join(f"{rnd.choice('bcdfgh')}{rnd.randrange(3000)}" for _ in range(400)) for _ in range(300)]
    rows = [(i, f"https://x/{i}", f"title {i} of its own {i * i}", b, "2024-01-01", "official", 0) for i, b in enumerate(bodies)]
    rows += [(1000 + i, f"https://y/{i}", rows[i][2], rows[i][3] + " end", "2024-01-01", "secondary", 0) for i in range(30)]
    place = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    got = {r.id: r.partner_id for r in dedup.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 1000 + i for i in range(30)} | {1000 + i: i for i in range(30)}
    stored = sum(os.path.getsize(f) for n in set(os.listdir(place)) - before for f in glob.glob(f"{place}/{n}/*.parquet"))
    assert stored < sum(len(r[3]) for r in rows)


def test_shingle_keys_are_the_sets_of_shingles():
    rnd = random.Random(8)
    texts = ["", "one", "one two three four five", "one two three four five six", "a b c d e a b c d e a b c d e f", "x " * 7 + "x"]
    texts += [" ".join(rnd.choice(["a", "bb", "東京", "c9"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    want = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.split() for t in texts)]
    keys, row = dedup._shingle_keys(pa.array(["left out", *texts])[1:])
    got = [set(keys[row == i].tolist()) for i in range(len(texts))]
    assert [len(g) for g in got] == [len(w) for w in want] and len(keys) == sum(map(len, want))
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_sets_travel_only_for_pairs_that_titles_and_sizes_leave(spark, monkeypatch):
    """Crowded classes are dealt to salts, others are not repeated."""
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"https://x/{i}", "one same title here", f"{body} x{i}", "official") for i in range(6)]
    rows += [(6, "https://x/6", "quite another headline", body, "official"), (7, "https://x/7", "one same title here", f"{body} " + " ".join(f"v{i}" for i in range(60)), "official")]
    df = spark.createDataFrame(rows, "id long, url string, title string, body string, trust_tier string")
    sig = dedup.prepare(df.withColumn("published_at", F.lit("2024-01-01")).withColumn("dedupe_priority", F.lit(0)))
    written = []
    monkeypatch.setattr(dedup, "cut", lambda x, cut=dedup.cut: written.append(cut(x)) or written[-1])
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 8)] + [(3, 2)], "l long, r long")
    want = {(i, 0) for i in range(1, 6)} | {(3, 2)}
    for crowd in (1, 1000):
        monkeypatch.setattr(dedup, "CROWD", crowd)
        assert {(r.l, r.r) for r in dedup._verify(pairs, sig, sig, 0.9).collect()} == want
        assert {(r.l, r.r) for r in written[-1].collect()} == want


def test_lexical_function_spreads_tables_of_few_blocks(spark):
    spark.conf.set("spark.newsiq.partitions", "3")
    try:
        plan = spark_entry.queries()["udx_2_match_lexical"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.newsiq.partitions")
    assert "RoundRobinPartitioning(3)" in plan
