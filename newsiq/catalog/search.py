"""Catalog: retrieval, fusion, reranking, contexts, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsiq.catalog import query
from newsiq.catalog.sqltext import SIM, TRGM
from newsiq.operators import chunks as ch
from newsiq.operators import context as cx
from newsiq.operators import questions as qs
from newsiq.operators import retrieval as rt
from newsiq.operators import vectorindex
from newsiq.operators.termindex import term_matches

K = 10
R9 = lambda a, b: f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"



def knn_sql(name: str, corpus: str, id_col: str, k: int) -> str:
    """CTE: nearest k rows of ``corpus`` per case."""
    return f"""{name} AS (SELECT query_id, {id_col}, score, rank FROM (
      SELECT c.case_id AS query_id, v.{id_col}, {R9('c.query_embedding', 'v.embedding')} AS score,
        row_number() OVER (PARTITION BY c.case_id ORDER BY {R9('c.query_embedding', 'v.embedding')} DESC, v.{id_col}) AS rank
      FROM cases c, {corpus} v WHERE v.embedding IS NOT NULL) z WHERE rank <= {k})"""


def chunk_sql(name: str, k: int, m: int = 5, where: str = "embedding_model = 'm1'") -> str:
    """CTEs: overfetched chunks, best chunk per article, articles re-ranked."""
    return f"""{name}_c AS (SELECT chunk_id, article_id, chunk_index, embedding FROM chunks WHERE {where}),
    {knn_sql(name + '_h', name + '_c', 'chunk_id', k * m)},
    {name}_b AS (SELECT h.query_id, h.chunk_id, c.article_id, c.chunk_index, h.score, h.rank AS chunk_rank,
        row_number() OVER (PARTITION BY h.query_id, c.article_id ORDER BY h.score DESC, h.rank) AS rn FROM {name}_h h JOIN {name}_c c USING (chunk_id)),
    {name} AS (SELECT * FROM (SELECT query_id, chunk_id, article_id, chunk_index, score, chunk_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_rank) AS article_rank
        FROM {name}_b WHERE rn = 1) z WHERE article_rank <= {k})"""


def queries_of(t):
    return t.cases.select(F.col("case_id").alias("query_id"), "question", "query_embedding", "lang", "primary_article_id")


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("score") else (F.col(c).cast("long").alias(c) if "rank" in c else F.col(c)) for c in cols])


@query("ret_1_dense", f"WITH {knn_sql('h', 'article_vectors', 'article_id', K)} SELECT query_id, article_id, round(score, 6) AS score, rank FROM h", ("cases", "article_vectors"))
def dense(t):
    return rounded(rt.dense(queries_of(t), t.article_vectors, K), "query_id", "article_id", "score", "rank")


_FIELDS = ("title", "title_en", "title_zh", "summary", "summary_en", "summary_zh")
_TERMS = (
    "SELECT DISTINCT query_id, lower(trim(term)) AS term FROM (SELECT case_id AS query_id, unnest(list_distinct_ordered[1:10]) AS term FROM ("
    "SELECT case_id, list_filter(list_reduce_distinct, lambda w: length(w) >= 2) AS list_distinct_ordered FROM ("
    "SELECT case_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_reduce_distinct FROM ("
    "SELECT case_id, list_filter(regexp_split_to_array(regexp_replace(lower(QUESTION), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2) AS ws FROM cases) a) b) c) d WHERE length(trim(term)) >= 2"
)


def lexical_sql(name: str, k: int, question: str = "question") -> str:
    """CTEs: terms, matching articles, summed trigram scores, best k per case."""
    grams = ", ".join(f"{TRGM(f'coalesce({f}, chr(0))')} AS g{i}" for i, f in enumerate(_FIELDS))
    hit = " OR ".join(f"contains(f{i}, t.term)" for i in range(6))
    sims = ", ".join(f"{SIM(f'a.g{i}', 't.tg')} * {4 if i < 3 else 2}" for i in range(6))
    low = ", ".join(f"lower(coalesce({f}, '')) AS f{i}" for i, f in enumerate(_FIELDS))
    return f"""{name}_t AS ({_TERMS.replace('QUESTION', question)}),
    {name}_d AS MATERIALIZED (SELECT term, {TRGM('term')} AS tg FROM (SELECT DISTINCT term FROM {name}_t) x),
    {name}_a AS MATERIALIZED (SELECT id AS article_id, {low}, {grams} FROM news),
    {name}_p AS MATERIALIZED (SELECT a.article_id, t.term, greatest({sims}) AS s FROM {name}_a a JOIN {name}_d t ON ({hit})),
    {name}_s AS (SELECT q.query_id, p.article_id, round(sum(p.s), 9) AS score FROM {name}_t q JOIN {name}_p p USING (term) GROUP BY 1, 2),
    {name} AS (SELECT * FROM (SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM {name}_s WHERE score > 0) z WHERE rank <= {k})"""


def news_articles(t):
    return t.news.withColumnRenamed("id", "article_id")


@query("ret_2_lexical", f"WITH {lexical_sql('h', K)} SELECT query_id, article_id, round(score, 6) AS score, rank FROM h", ("cases", "news"))
def lexical(t):
    return rounded(rt.lexical(queries_of(t), news_articles(t), K, partitions=t.spread), "query_id", "article_id", "score", "rank")


@query("joi_7_substring_join", f"WITH {lexical_sql('h', K)} SELECT article_id, term FROM h_p", ("cases", "news"))
def substring_join(t):
    terms = rt.term_table(queries_of(t)).select("term").distinct()
    return term_matches(news_articles(t), terms, "article_id", list(_FIELDS), partitions=t.spread, plain=True)


@query(
    "ret_3_chunk_dense",
    f"WITH {chunk_sql('h', K)} SELECT query_id, article_id, chunk_id, chunk_index, round(score, 6) AS score, chunk_rank, article_rank FROM h",
    ("cases", "chunks"),
)
def chunk_dense(t):
    return rounded(
        rt.chunk_dense(queries_of(t), t.chunks, K, model="m1"), "query_id", "article_id", "chunk_id", "chunk_index", "score", "chunk_rank", "article_rank"
    )


@query(
    "ret_3_production_chunks",
    f"WITH {chunk_sql('h', 4, where=chr(39).join(['embedding_model = ', 'm1', ' AND chunking_version = ', 'v1', '']))} SELECT h.query_id, h.article_id, h.chunk_id, n.title, round(h.score, 6) AS score, h.article_rank FROM h JOIN news n ON n.id = h.article_id",
    ("cases", "chunks", "news"),
)
def production_chunks(t):
    hits = rt.chunk_dense(queries_of(t), t.chunks, 4, version="v1", model="m1")
    hits = hits.join(t.news.select(F.col("id").alias("article_id"), "title"), "article_id")
    return rounded(hits, "query_id", "article_id", "chunk_id", "title", "score", "article_rank")


@query(
    "joi_13_nearest_neighbour_join",
    f"WITH {knn_sql('h', 'chunks', 'chunk_id', 25)} SELECT query_id, chunk_id, rank FROM h",
    ("cases", "chunks"),
)
def nearest_neighbour_join(t):
    from newsiq.operators.knn import knn_join

    # small blocks, so that every query block meets many corpus blocks
    out = knn_join(queries_of(t), t.chunks, 25, id_col="chunk_id", block_queries=8, block_rows=100)
    return rounded(out, "query_id", "chunk_id", "rank")


@query(
    "joi_13_vector_index",
    f"WITH {knn_sql('h', 'chunks', 'chunk_id', 25)} SELECT h.query_id, h.chunk_id, c.article_id, h.rank FROM h JOIN chunks c USING (chunk_id)",
    ("cases", "chunks"),
)
def vector_index(t):
    """The same search on a stored index of cells, whose bounds skip blocks."""
    index = vectorindex.build(t.chunks, "chunk_id", carry=["article_id"])
    out = vectorindex.search(index, queries_of(t), 25, block_queries=8)
    return out.select("query_id", "chunk_id", "article_id", F.col("rank").cast("long").alias("rank"))


@query("joi_13_probe_recall", "SELECT count(*) AS questions, true AS recall_reached FROM cases", ("cases",))
def probe_recall(t):
    """Recall of the probing search against the exact one, over all questions and all chunks."""
    index = vectorindex.build(t.chunks, "chunk_id")
    truth = vectorindex.search(index, queries_of(t), 10).select("query_id", "chunk_id")
    probes = vectorindex.probes_for(index, queries_of(t), 10, 0.92)
    probed = vectorindex.search(index, queries_of(t), 10, probes=probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = truth.join(probed, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return both.agg(F.count("*").alias("questions"), (F.avg("recall") >= 0.9).alias("recall_reached"))


def _uuid(column: str) -> str:
    """A UUID-shaped key made of an integer one, in both dialects."""
    digest = f"md5(CAST({column} AS VARCHAR(20)))"
    return "concat(" + ", '-', ".join(f"substr({digest}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


@query(
    "joi_13_string_keys",
    f"""WITH keyed AS (SELECT {_uuid('chunk_id')} AS chunk_id, embedding FROM chunks), {knn_sql('h', 'keyed', 'chunk_id', 25)}
      SELECT {_uuid('query_id')} AS query_id, chunk_id, rank FROM h""",
    ("cases", "chunks"),
)
def nearest_neighbour_string_keys(t):
    from newsiq.operators.knn import knn_join

    queries = t.cases.select(F.expr(_uuid("case_id")).alias("query_id"), "query_embedding")
    chunks = t.chunks.select(F.expr(_uuid("chunk_id")).alias("chunk_id"), "embedding")
    return rounded(knn_join(queries, chunks, 25, id_col="chunk_id"), "query_id", "chunk_id", "rank")


@query("win_3_distance_rank", f"WITH {knn_sql('h', 'chunks', 'chunk_id', 40)} SELECT query_id, chunk_id, rank FROM h", ("cases", "chunks"))
def distance_rank(t):
    return rounded(rt.dense(queries_of(t), t.chunks, 40, id_col="chunk_id"), "query_id", "chunk_id", "rank")


@query(
    "win_4_best_chunk_per_article",
    f"WITH {chunk_sql('h', 20, 2)} SELECT query_id, article_id, chunk_id, article_rank FROM h",
    ("cases", "chunks"),
)
def best_chunk_per_article(t):
    return rounded(rt.chunk_dense(queries_of(t), t.chunks, 20, 2, model="m1"), "query_id", "article_id", "chunk_id", "article_rank")


@query(
    "top_6_overfetch",
    f"WITH {chunk_sql('h', 12, 1)} SELECT query_id, count(*) AS articles, max(chunk_rank) AS last_chunk_rank FROM h GROUP BY 1",
    ("cases", "chunks"),
)
def overfetch(t):
    # without overfetch several chunks of one article leave fewer than k articles
    out = rt.chunk_dense(queries_of(t), t.chunks, 12, 0, model="m1")
    return out.groupBy("query_id").agg(F.count("*").alias("articles"), F.max("chunk_rank").cast("long").alias("last_chunk_rank"))


PREFER = f"""p_ready AS (SELECT article_id, embedding FROM analysis_vectors WHERE status = 'ready' AND embedding IS NOT NULL),
  p_rest AS (SELECT * FROM article_vectors v WHERE NOT EXISTS (SELECT 1 FROM p_ready r WHERE r.article_id = v.article_id)),
  {knn_sql('p_a', 'p_ready', 'article_id', K)}, {knn_sql('p_b', 'p_rest', 'article_id', K)},
  prefer AS (SELECT * FROM (SELECT query_id, article_id, score, embedding_source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id, embedding_source) AS rank FROM (
    SELECT *, 'deep_analysis' AS embedding_source FROM p_a UNION ALL SELECT *, 'daily_news' FROM p_b) u) z WHERE rank <= {K})"""


@query(
    "ret_4_prefer_analysis",
    f"WITH {PREFER} SELECT query_id, article_id, round(score, 6) AS score, embedding_source, rank FROM prefer",
    ("cases", "article_vectors", "analysis_vectors"),
)
def prefer_analysis(t):
    out = rt.prefer_analysis(queries_of(t), t.article_vectors, t.analysis_vectors, K)
    return rounded(out, "query_id", "article_id", "score", "embedding_source", "rank")


@query(
    "top_5_branch_top_k",
    f"WITH {PREFER} SELECT query_id, embedding_source, count(*) AS hits FROM prefer GROUP BY 1, 2",
    ("cases", "article_vectors", "analysis_vectors"),
)
def branch_top_k(t):
    out = rt.prefer_analysis(queries_of(t), t.article_vectors, t.analysis_vectors, K)
    return out.groupBy("query_id", "embedding_source").agg(F.count("*").alias("hits"))


def fuse_sql(name: str, parts: list[tuple[str, str, float]], k: int, cut: int) -> str:
    """CTE: weighted reciprocal-rank fusion of (relation, source, weight) lists."""
    union = " UNION ALL ".join(
        f"SELECT query_id, article_id, rank, {i} AS l, {w}e0 / ({k} + rank) AS s, '{src}' AS src FROM {rel}" for i, (rel, src, w) in enumerate(parts)
    )
    return f"""{name} AS (SELECT * FROM (SELECT query_id, article_id, score_final, fusion_sources, row_number() OVER (PARTITION BY query_id ORDER BY score_final DESC, f.l, f.r, article_id) AS rank FROM (
      SELECT query_id, article_id, round(sum(s), 12) AS score_final, min(struct_pack(l := l, r := rank)) AS f, string_agg(src, ',' ORDER BY l, rank) AS fusion_sources
      FROM ({union}) u GROUP BY 1, 2) g) z WHERE rank <= {cut})"""


def as_rank(name: str, rel: str) -> str:
    return f"{name} AS (SELECT query_id, article_id, article_rank AS rank FROM {rel})"


@query(
    "ret_5_rrf",
    f"WITH {chunk_sql('h', 30)}, {as_rank('hr', 'h')}, {lexical_sql('x', 30)}, {fuse_sql('f', [('hr', 'chunk', 1), ('x', 'lexical', 1)], 60, 1000000)} SELECT query_id, article_id, round(score_final, 6) AS score_final, fusion_sources, rank FROM f",
    ("cases", "chunks", "news"),
)
def rrf(t):
    q = queries_of(t)
    a = rt.chunk_dense(q, t.chunks, 30, model="m1").withColumnRenamed("article_rank", "rank").withColumn("source_key", F.lit("chunk"))
    b = rt.lexical(q, news_articles(t), 30, partitions=t.spread).withColumn("source_key", F.lit("lexical"))
    return rounded(rt.rrf([a, b]), "query_id", "article_id", "score_final", "fusion_sources", "rank")


@query(
    "ret_6_weighted_rrf",
    f"WITH {chunk_sql('h', 30)}, {as_rank('hr', 'h')}, {knn_sql('v', 'article_vectors', 'article_id', 10)}, {fuse_sql('f', [('hr', 'chunk', 0.5), ('v', 'vector', 2)], 50, 1000000)} SELECT query_id, article_id, round(score_final, 6) AS score_final, fusion_sources, rank FROM f".replace("0.5e0", "0.5").replace("2e0", "2"),
    ("cases", "chunks", "article_vectors"),
)
def weighted_rrf(t):
    q = queries_of(t)
    a = rt.chunk_dense(q, t.chunks, 30, model="m1").withColumnRenamed("article_rank", "rank").withColumn("source_key", F.lit("chunk"))
    b = rt.dense(q, t.article_vectors, 10).withColumn("source_key", F.lit("vector"))
    return rounded(rt.weighted_rrf([a, b], {"chunk": 0.5, "vector": 2.0}), "query_id", "article_id", "score_final", "fusion_sources", "rank")


# entity terms of a question, as one text: capitalised runs, amounts, code words, first twelve
_CAP = "[A-Z][A-Za-z0-9$.-]*"
_FOUND = f"""list_concat(list_concat(regexp_extract_all(question, '\\b{_CAP}(?:\\s+{_CAP}){{0,3}}\\b', 0), regexp_extract_all(question, '\\$?\\d+(?:\\.\\d+)?\\s?(?:M|B|亿|万|万美元|亿美元)?', 0, 'i')),
  regexp_extract_all(question, '\\b[a-z]+[A-Z][A-Za-z0-9_-]*\\b|\\b[a-z]+(?:search|ctl|cli)\\b', 0))"""
_DISTINCT = "list_filter(XS, lambda w, i: list_position(XS, w) = i)"
ENTITIES = f"list_filter(list_transform({_DISTINCT.replace('XS', _FOUND)}, lambda w: trim(w)), lambda w: length(w) >= 2)[1:12]"
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)"
LEX_TERMS = f"({_DISTINCT.replace('XS', _TOKENS)})[1:10]"
ENTITY_QUERY = f"array_to_string(list_concat({ENTITIES}, ({LEX_TERMS})[1:6]), ' ')"

# external scores of candidate positions, as a reranker would return them
_RR_SCORE = "CAST((query_id * 31 + CAST(index AS BIGINT) * 17) % 97 AS DOUBLE) / 97"


def rerank_scores(t):
    idx = t.cases.select(F.col("case_id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("index"))
    return idx.where("(query_id + index) % 4 <> 3").withColumn("score", F.expr(_RR_SCORE))


RR_CTE = f"""rr AS (SELECT query_id, index, {_RR_SCORE} AS score FROM (SELECT case_id AS query_id, unnest(generate_series(0, 29)) AS index FROM cases) i WHERE (query_id + index) % 4 <> 3)"""
STRATEGY_TABLES = ("cases", "chunks", "news", "article_vectors", "analysis_vectors")



def run_strategy(t, name, **extra):
    return rounded(
        rt.run(
            name, queries_of(t), K, chunks=t.chunks, articles=news_articles(t), article_vectors=t.article_vectors,
            analysis_vectors=t.analysis_vectors, model="m1", partitions=t.spread, **extra,
        ),
        "query_id", "article_id", "rank", "score_final",
    )


def strategy_sql(name: str) -> str:
    if name == "dense":
        return f"WITH {PREFER} SELECT query_id, article_id, rank, round(score, 6) AS score_final FROM prefer"
    if name == "lexical":
        return f"WITH {lexical_sql('h', K)} SELECT query_id, article_id, rank, round(score, 6) AS score_final FROM h"
    if name == "chunk_dense":
        return f"WITH {chunk_sql('h', K)} SELECT query_id, article_id, article_rank AS rank, round(score, 6) AS score_final FROM h"
    tail = "SELECT query_id, article_id, rank, round(score_final, 6) AS score_final FROM f"
    if name == "hybrid":
        return f"WITH {PREFER}, {lexical_sql('x', K)}, {fuse_sql('f', [('prefer', 'vector', 1), ('x', 'lexical', 1)], 60, K)} {tail}"
    if name == "chunk_hybrid":
        return f"WITH {chunk_sql('h', 30)}, {as_rank('hr', 'h')}, {lexical_sql('x', 30)}, {fuse_sql('f', [('hr', 'vector', 1), ('x', 'lexical', 1)], 50, K)} {tail}"
    if name == "entity_hybrid":
        return f"WITH {chunk_sql('h', 30)}, {as_rank('hr', 'h')}, {lexical_sql('x', 30, ENTITY_QUERY)}, {fuse_sql('f', [('hr', 'vector', 1), ('x', 'lexical', 1)], 50, K)} {tail}"
    fused = f"WITH {chunk_sql('h', 30)}, {as_rank('hr', 'h')}, {lexical_sql('x', 30)}, {fuse_sql('f', [('hr', 'chunk', 1), ('x', 'lexical', 1)], 60, 30)}, {RR_CTE}"
    return f"""{fused} SELECT query_id, article_id, rank, round(s, 6) AS score_final FROM (
      SELECT f.query_id, f.article_id, coalesce(a.score, b.score, 0) AS s, row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(a.score, b.score, 0) DESC, f.rank) AS rank
      FROM f LEFT JOIN rr a ON a.query_id = f.query_id AND a.index = f.rank - 1 LEFT JOIN rr b ON b.query_id = f.query_id AND b.index = f.rank) z WHERE rank <= {K}"""


for _name in rt.STRATEGIES:

    def _register(name=_name):
        @query(f"ret_7_{name}", strategy_sql(name), STRATEGY_TABLES)
        def strategy(t):
            extra = {"scores": rerank_scores(t)} if name == "rerank_hybrid" else {}
            return run_strategy(t, name, **extra)

    _register()


@query(
    "ret_8_rerank",
    f"""WITH {chunk_sql('h', K)}, {RR_CTE} SELECT query_id, article_id, previous_rank, rank, round(s, 6) AS score_final FROM (
      SELECT h.query_id, h.article_id, h.article_rank AS previous_rank, coalesce(a.score, b.score, 0) AS s, row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(a.score, b.score, 0) DESC, h.article_rank) AS rank
      FROM h LEFT JOIN rr a ON a.query_id = h.query_id AND a.index = h.article_rank - 1 LEFT JOIN rr b ON b.query_id = h.query_id AND b.index = h.article_rank) z""",
    ("cases", "chunks"),
)
def rerank(t):
    c = rt.chunk_dense(queries_of(t), t.chunks, K, model="m1").select("query_id", "article_id", F.col("article_rank").alias("rank"), F.col("score").alias("score_final"))
    return rounded(rt.rerank(c, rerank_scores(t)), "query_id", "article_id", "previous_rank", "rank", "score_final")


def context_rows(t, k: int = K):
    """Chunk candidates with title and a text to quote."""
    hits = rt.chunk_dense(queries_of(t), t.chunks, k, model="m1").select(
        "query_id", "article_id", F.col("article_rank").alias("rank"), F.col("score").alias("score_final")
    )
    hits = hits.join(t.news.select(F.col("id").alias("article_id"), "title", F.col("article_content").alias("context")), "article_id")
    return hits.join(queries_of(t).drop("query_embedding"), "query_id")


CTX = f"""{chunk_sql('h', K)}, ctx AS (SELECT h.query_id, h.article_id, h.article_rank AS rank, h.score AS score_final, n.title, n.article_content AS context, c.question, c.lang, c.primary_article_id
   FROM h JOIN news n ON n.id = h.article_id JOIN cases c ON c.case_id = h.query_id)"""
CTX_TABLES = ("cases", "chunks", "news")

_KEY_SQL = """sha256('{"cache_version":"rag-rerank-cache-v1","normalized_query":' || to_json(lower(trim(regexp_replace(any_value(question), '\\s+', ' ', 'g')))) || ',"ordered_candidate_ids":[' ||
   string_agg('"' || article_id || '"', ',' ORDER BY rank) || '],"context_hashes":[' || string_agg('"' || sha256(substr(coalesce(context, ''), 1, 4000)) || '"', ',' ORDER BY rank) ||
   '],"rerank_model":"m","chunking_version":null,"strategy_variant":"rerank_hybrid"}')"""


@query("ret_9_cache_keys", f"WITH {CTX} SELECT query_id, {_KEY_SQL} AS cache_key FROM ctx GROUP BY query_id", CTX_TABLES)
def cache_keys(t):
    return rt.cache_keys(context_rows(t), "m").select("query_id", "cache_key")


@query(
    "ret_9_cache_hits",
    f"""WITH {CTX}, s AS (SELECT *, CAST((article_id * 7) % 13 AS DOUBLE) / 13 AS sc FROM ctx WHERE lang = 'en')
      SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, rank) AS rank, round(sc, 6) AS score_rerank FROM s""",
    CTX_TABLES,
)
def cache_hits(t):
    rows = context_rows(t)
    # what earlier runs left behind: English questions fresh, the others stale
    keys = rt.cache_keys(rows, "m").select("query_id", "cache_key")
    cache = rows.join(keys, "query_id").select(
        "cache_key", "article_id", F.expr("CAST((article_id * 7) % 13 AS DOUBLE) / 13").alias("score_rerank"),
        F.when(F.col("lang") != "en", "model_changed").alias("stale_reason"),
    )
    hits, _ = rt.cache_lookup(rows, cache, "m")
    return rounded(hits, "query_id", "article_id", "rank", "score_rerank")


_LEX_CONV = LEX_TERMS.replace("question", "text")


@query("ret_10_lexical_terms", f"SELECT conv_id, turn, array_to_string({_LEX_CONV}, ' ') AS terms FROM conversations")
def lexical_terms(t):
    return t.conversations.select("conv_id", "turn", F.array_join(qs.lexical_terms("text"), " ").alias("terms"))


@query("ret_11_entity_terms", f"SELECT conv_id, turn, array_to_string({ENTITIES.replace('question', 'text')}, ' | ') AS terms FROM (SELECT conv_id, turn, text || ' openAI raised $5.5 M vs kubectl 12' AS text FROM conversations) c")
def entity_terms(t):
    rows = t.conversations.withColumn("text", F.concat("text", F.lit(" openAI raised $5.5 M vs kubectl 12")))
    return rows.select("conv_id", "turn", F.array_join(qs.entity_terms("text"), " | ").alias("terms"))


@query(
    "ret_12_rewrite",
    f"""SELECT case_id, m.mode AS rewrite_mode, CASE m.mode WHEN 'none' THEN question WHEN 'hyde' THEN question || chr(10) || chr(10) || '{qs.HYDE_SUFFIX}'
        WHEN 'entity_expansion' THEN question || chr(10) || chr(10) || 'Key entities and exact terms: ' || {ENTITY_QUERY} WHEN 'decomposition' THEN question || chr(10) || {ENTITY_QUERY}
        ELSE question || chr(10) || chr(10) || '{qs.CONTEXT_SUFFIX}' END AS rewritten_query, m.mode IN ('none', 'entity_expansion', 'decomposition') AS accepted
      FROM cases, (VALUES ('none'), ('entity_expansion'), ('hyde'), ('decomposition'), ('context_completion')) m(mode)""",
    ("cases",),
)
def rewrite(t):
    rows = t.cases.select("case_id", "question", F.explode(F.array(*[F.lit(m) for m in qs.REWRITE_MODES])).alias("mode"))
    return rows.select("case_id", qs.rewritten("question", F.col("mode")).alias("r")).select("case_id", "r.rewrite_mode", "r.rewritten_query", "r.accepted")


INTENT = """CASE WHEN regexp_matches(t, 'compare|versus| vs |比较|对比') THEN 'comparison' WHEN regexp_matches(t, 'follow|previous|that|it|上述|刚才|这家公司|该公司') THEN 'ambiguous follow-up'
  WHEN regexp_matches(t, 'conflict|contradict|insufficient|低上下文|冲突') THEN 'low-context/conflicting evidence' WHEN regexp_matches(t, 'and|multi-hop|between|同时|以及|之间') THEN 'multi-hop'
  WHEN len(list_filter(list_distinct(regexp_extract_all(q, '[A-Z][A-Za-z0-9$.-]+|\\$[0-9]|OpenAI|Anthropic|Google|Microsoft|Okta|xAI', 0)), lambda w: w NOT IN ('What', 'When', 'Why', 'How', 'Where', 'Who'))) >= 2 OR regexp_matches(q, '\\$[0-9]') THEN 'entity-heavy' ELSE 'simple' END"""


@query(
    "ret_13_plan",
    f"""SELECT conv_id, turn, intent, 'agentic-' || substr(sha256(intent || ':' || q || ':'), 1, 12) AS plan_id, CASE n WHEN 1 THEN 'sq1' ELSE 'sq2' END AS subquery_id FROM (
      SELECT *, unnest(generate_series(1, CASE WHEN intent IN ('comparison', 'multi-hop') THEN 2 ELSE 1 END)) AS n FROM (
        SELECT conv_id, turn, q, {INTENT} AS intent FROM (SELECT conv_id, turn, text AS q, lower(text || ' ') AS t FROM conversations) a) b) c""",
)
def plan(t):
    return qs.plan(t.conversations, "text").select("conv_id", "turn", "intent", "plan_id", "subquery_id")


@query(
    "ret_14_merge_best",
    f"""WITH {knn_sql('a', 'article_vectors', 'article_id', K)}, {chunk_sql('h', K)}, u AS (SELECT query_id, article_id, score, rank, 0 AS l FROM a UNION ALL SELECT query_id, article_id, score, article_rank, 1 FROM h),
      g AS (SELECT query_id, article_id, max(score) AS s, min(struct_pack(l := l, r := rank)) AS f FROM u GROUP BY 1, 2)
      SELECT query_id, article_id, round(s, 6) AS score_final, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, f.l, f.r, article_id) AS rank FROM g""",
    ("cases", "article_vectors", "chunks"),
)
def merge_best(t):
    q = queries_of(t)
    a = rt.dense(q, t.article_vectors, K).withColumnRenamed("score", "score_final")
    b = rt.chunk_dense(q, t.chunks, K, model="m1").select("query_id", "article_id", F.col("article_rank").alias("rank"), F.col("score").alias("score_final"))
    return rounded(rt.merge_best([a, b], ["article_id"]), "query_id", "article_id", "score_final", "rank")


@query(
    "ret_15_two_rounds",
    f"""WITH p AS (SELECT case_id, intent, 'agentic-' || substr(sha256(intent || ':' || q || ':'), 1, 12) AS plan_id FROM (SELECT case_id, q, {INTENT} AS intent FROM (SELECT case_id, question AS q, lower(question || ' ') AS t FROM cases) a) b),
      r1 AS (SELECT p.plan_id, count(DISTINCT g.article_id) FILTER (WHERE g.relevance_grade = 3) AS n1, count(DISTINCT g.article_id) AS n2 FROM p LEFT JOIN gold g USING (case_id) GROUP BY 1),
      s AS (SELECT DISTINCT p.plan_id, p.intent, n1, n2, p.intent <> 'simple' AND NOT (n1 > 0 AND NOT (p.intent = 'comparison' AND n1 < 2)) AS retry FROM p JOIN r1 USING (plan_id))
      SELECT plan_id, intent, CASE WHEN retry THEN n2 ELSE n1 END AS candidate_count, CAST(CASE WHEN retry THEN 2 ELSE 1 END AS BIGINT) AS retrieval_rounds,
        CASE WHEN intent = 'simple' THEN 'linear_simple_question' WHEN retry AND n2 > 0 THEN 'critique_retry_satisfied' WHEN NOT retry AND n1 > 0 THEN 'critique_sufficient' ELSE 'max_rounds_reached' END AS stop_reason FROM s""",
    ("cases", "gold"),
)
def two_rounds(t):
    plans = qs.plan(t.cases.select("case_id", "question"))

    def retriever(df, round_no):
        # the first round only finds the best evidence, the second any
        known = t.gold.where("relevance_grade = 3") if round_no == 1 else t.gold
        return df.join(known.select("case_id", "article_id", F.lit(1.0).alias("score_final")), "case_id")

    out = rt.two_rounds(plans, retriever, ("article_id",))
    return out.select("plan_id", "intent", "candidate_count", "retrieval_rounds", "stop_reason")


_RELATED = f"""WITH {CTX}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ctx WHERE article_id <> primary_article_id),
  rel AS (SELECT query_id, chr(10) || chr(10) || string_agg('[' || CASE WHEN lang = 'zh' THEN '相关文章' ELSE 'Related article' END || ' ' || n || '] ' || title || chr(10) || substr(coalesce(context, ''), 1, 800), chr(10) || chr(10) ORDER BY n) AS related_context,
    string_agg(article_id, ',' ORDER BY n) AS injected_ids, count(*) AS injected_count FROM e WHERE n <= 3 GROUP BY query_id)"""


@query("ret_16_related_context", _RELATED + " SELECT * FROM rel", CTX_TABLES)
def related_context(t):
    return cx.related_context(context_rows(t))


@query(
    "ret_16_pack",
    f"""WITH {CTX}, p AS (SELECT query_id, substr(string_agg(concat_ws(chr(10), nullif(title, ''), nullif(context, '')), chr(10) || chr(10) ORDER BY rank), 1, 16000) AS context_text, string_agg(article_id, ',' ORDER BY rank) AS article_ids FROM ctx GROUP BY query_id)
      SELECT query_id, article_ids, sha256(context_text) AS context_hash, length(context_text) AS context_chars FROM p""",
    CTX_TABLES,
)
def pack(t):
    return cx.pack(context_rows(t)).select("query_id", "article_ids", "context_hash", "context_chars")


_DISP = """CASE WHEN article_id = primary_article_id THEN 'primary_article_excluded' WHEN n > 3 THEN 'rank_beyond_context_cap' END"""
_MARKED = f"WITH {CTX}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id = primary_article_id ORDER BY rank) AS n FROM ctx)"


@query("ret_17_disposition", _MARKED + f" SELECT query_id, article_id, rank, {_DISP} IS NULL AS injected, {_DISP} AS drop_reason FROM m", CTX_TABLES)
def disposition(t):
    return rounded(cx.disposition(context_rows(t)), "query_id", "article_id", "rank", "injected", "drop_reason")


@query(
    "ret_17_history_disposition",
    f"""WITH {CTX}, e AS (SELECT *, article_id % 4 = 0 AS selected, article_id % 5 = 1 AS in_window FROM ctx),
      k AS (SELECT *, coalesce(sum(CASE WHEN NOT selected AND NOT in_window THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM e)
      SELECT query_id, article_id, CASE WHEN taken >= 3 THEN 'not_evaluated_after_context_cap' WHEN selected THEN 'current_window_selected' WHEN in_window THEN 'current_window_article' END AS drop_reason FROM k""",
    CTX_TABLES,
)
def history_disposition(t):
    rows = context_rows(t).withColumn("selected", F.expr("article_id % 4 = 0")).withColumn("in_window", F.expr("article_id % 5 = 1"))
    return cx.history_disposition(rows, 3).select("query_id", "article_id", "drop_reason")


@query(
    "ret_18_trace_header",
    _RELATED
    + """ SELECT c.query_id, any_value(c.question) AS query_text, 'chunk_dense' AS retrieval_strategy, 'chunks' AS retriever_name, CAST(10 AS BIGINT) AS match_count, count(*) AS candidate_count,
      coalesce(any_value(rel.injected_count), 0) AS injected_count, coalesce(any_value(length(rel.related_context)), 0) AS context_total_chars FROM ctx c LEFT JOIN rel USING (query_id) GROUP BY c.query_id""",
    CTX_TABLES,
)
def trace_header(t):
    return cx.trace(context_rows(t), "chunk_dense", "chunks", K)[0]


@query(
    "ret_18_trace_candidates",
    _MARKED + f" SELECT query_id, rank, article_id, title, substr(coalesce(context, ''), 1, 1000) AS summary_excerpt, round(score_final, 6) AS score_final, {_DISP} IS NULL AS injected, {_DISP} AS drop_reason FROM m",
    CTX_TABLES,
)
def trace_candidates(t):
    return rounded(cx.trace(context_rows(t), "chunk_dense", "chunks", K)[1], "query_id", "rank", "article_id", "title", "summary_excerpt", "score_final", "injected", "drop_reason")


@query(
    "ret_18_trace_contexts",
    _RELATED
    + " SELECT query_id, CAST(2 AS BIGINT) AS ordinal, 'answer_question_related_context' AS context_role, related_context AS context_text, sha256(related_context) AS context_hash, length(related_context) AS context_chars FROM rel",
    CTX_TABLES,
)
def trace_contexts(t):
    return cx.trace(context_rows(t), "chunk_dense", "chunks", K)[2]


# ---------------------------------------------------------------- chunks


def chunker_sql(target: int, overlap: int) -> str:
    """Recursive CTEs that walk the paragraphs of each document."""
    return f"""para AS MATERIALIZED (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
    walk AS (
      SELECT doc_id, 0 AS i, '' AS buf, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS cur, CAST(NULL AS VARCHAR) AS emitted, CAST(0 AS BIGINT) AS emitted_start FROM para
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN full_ THEN right(buf, {overlap}) || chr(10) || chr(10) || p WHEN buf <> '' THEN buf || chr(10) || chr(10) || p ELSE p END,
        CASE WHEN full_ THEN greatest(0, pos_ - least(length(buf), {overlap})) WHEN buf = '' THEN pos_ ELSE start END, pos_ + length(p), CASE WHEN full_ THEN buf END, start
      FROM (SELECT w.doc_id, w.i, w.buf, w.start, w.cur, d.ps[w.i + 1] AS p, w.cur + instr(substr(d.text, w.cur + 1), d.ps[w.i + 1]) - 1 AS pos_,
          w.buf <> '' AND length(w.buf) + 2 + length(d.ps[w.i + 1]) > {target} AS full_ FROM walk w JOIN para d USING (doc_id) WHERE w.i < len(d.ps)) s),
    pieces AS (SELECT doc_id, i, emitted AS chunk_text, emitted_start AS char_start FROM walk WHERE emitted IS NOT NULL
      UNION ALL SELECT w.doc_id, w.i + 1, w.buf, w.start FROM walk w JOIN para d USING (doc_id) WHERE w.i = len(d.ps) AND w.buf <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM pieces)"""


@query(
    "chk_1_split",
    f"WITH RECURSIVE {chunker_sql(1200, 200)} SELECT doc_id, chunk_index, sha256(chunk_text) AS chunk_hash, char_start, char_start + length(chunk_text) AS char_end FROM numbered",
)
def split(t):
    rows = t.documents.select("doc_id", F.posexplode(ch.split_chunks("text", 1200, 200, r"\n+")).alias("chunk_index", "c"))
    return rows.select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("c.chunk_text", 256).alias("chunk_hash"),
        F.col("c.char_start").cast("long").alias("char_start"), F.col("c.char_end").cast("long").alias("char_end"),
    )


@query(
    "chk_2_build",
    f"""WITH RECURSIVE {chunker_sql(3200, 600)}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_text ORDER BY chunk_index DESC) AS rn FROM numbered)
      SELECT doc_id, chunk_index, sha256(chunk_text) AS chunk_hash, CASE WHEN regexp_matches(chunk_text, '[㐀-鿿]') THEN 'zh' ELSE 'en' END AS language, CAST(ceil(length(chunk_text) / 4) AS BIGINT) AS token_estimate, 'paragraph' AS boundary_type FROM k WHERE rn = 1""",
)
def build(t):
    out = ch.build(t.spread_out(t.documents), "text", "doc_id", sep=r"\n+")
    return out.select("doc_id", "chunk_index", "chunk_hash", "language", "token_estimate", "boundary_type")


@query(
    "chk_3_backfill_targets",
    """SELECT id FROM news WHERE article_content IS NOT NULL AND length(article_content) >= 200 AND id IN (SELECT article_id FROM gold WHERE review_status = 'approved' AND relevance_grade >= 2)""",
    ("news", "gold"),
)
def backfill_targets(t):
    return ch.backfill_targets(t.news, t.gold).select("id")


@query(
    "chk_3_backfill_newest",
    "SELECT id FROM (SELECT id, article_content FROM news WHERE article_content IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 300) x WHERE length(article_content) >= 5000",
    ("news",),
)
def backfill_newest(t):
    return ch.backfill_targets(t.news, newest=300).select("id")


@query(
    "chk_4_coverage",
    "SELECT article_id, chunking_version, count(*) AS chunk_count, count(*) FILTER (WHERE embedding_model = 'm1' AND embedding IS NOT NULL) AS embedded_chunk_count FROM chunks GROUP BY 1, 2",
    ("chunks",),
)
def coverage(t):
    return ch.coverage(t.chunks, "m1")


@query(
    "chk_5_attach_embeddings",
    "SELECT d.doc_id AS chunk_id, CASE WHEN len(e.embedding) = 64 THEN e.vec_id END AS vec_id, coalesce(len(e.embedding) = 64, false) AS attached FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
)
def attach_embeddings(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "vec_id", "embedding")
    good, _ = ch.attach_embeddings(t.documents.select(F.col("doc_id").alias("chunk_id")), vectors, 64)
    return good.select("chunk_id", "vec_id", F.col("embedding").isNotNull().alias("attached"))
