"""Articles scored for every case of an evaluation set, a task's best per case.

Cases are packed into blocks with their terms, attributes and known pairs;
articles are packed where they lie, and every article block meets every case
block.  A task keeps the best articles of each case in their final order, so
what leaves it does not grow with the corpus, and nothing runs while the plan
is built.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsiq.operators.knn import values

BLOCK_CASES, BLOCK_ROWS, HELD = 1024, 512, 8
_MOST = (1 << 20) - 1


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Rows of a partition packed as one list per column."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in df.schema])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], names=schema.names)

    return df.mapInArrow(run, schema)


class _Cases:
    """One block of cases with their search automaton and their best articles so far."""

    def __init__(self, block: dict, n: int):
        self.n, self.ids = n, block["case_id"]
        self.count = k = len(self.ids)
        self.source = np.array(["\0" if s is None else str(s) for s in block["p_source"]], dtype=object)
        self.category = np.array(["\0" if c is None else c for c in block["p_category"]], dtype=object)
        self.published = np.array([np.nan if p is None else p for p in block["p_seconds"]], dtype=float)
        self.automaton, postings = ahocorasick.Automaton(), {}
        for case, terms in enumerate(block["terms"]):
            for t in terms or ():
                postings.setdefault(t["term"], []).append((case, t["q"], t["g"], t["t"]))
        self.postings = [np.array(p, dtype=np.int64) for p in postings.values()]
        for i, term in enumerate(postings):
            self.automaton.add_word(term, i)
        if postings:
            self.automaton.make_automaton()
        self.words: dict[str, list[int]] = {}
        for case, word in enumerate(block["p_word"]):
            self.words.setdefault(word, []).append(case)
        self.top, self.out = {}, {}
        for case in range(k):
            for article in block["retrieved"][case] or ():
                self.top.setdefault(article, []).append(case)
            for article in [*(block["known"][case] or ()), block["primary_article_id"][case]]:
                self.out.setdefault(article, []).append(case)
        self.best: list[np.ndarray] | None = None

    def add(self, aid: list, source: list, category: list, title: list, body: list, seconds: list, created: list) -> None:
        m, k = len(aid), self.count
        q, g, t = (np.zeros((m, k), dtype=np.int64) for _ in range(3))
        pool, top = np.zeros((m, k), dtype=bool), np.zeros((m, k), dtype=bool)
        same_source = np.array(["\1" if s is None else str(s) for s in source], dtype=object)[:, None] == self.source[None, :]
        same_category = np.array(["\1" if c is None else c for c in category], dtype=object)[:, None] == self.category[None, :]
        for r in range(m):
            found = {i for _, i in self.automaton.iter(body[r])} if self.postings else ()
            if found:
                rows = np.concatenate([self.postings[i] for i in found])
                for target, col in ((q, 1), (g, 2), (t, 3)):
                    target[r] = np.bincount(rows[:, 0], weights=rows[:, col], minlength=k)
            for word, at in self.words.items():
                if word in title[r]:
                    pool[r, at] = True
            top[r, self.top.get(aid[r], [])] = True
        pool |= same_source | same_category | top
        for r in range(m):
            pool[r, self.out.get(aid[r], [])] = False
        tag = t > 0
        worth = (top.astype(np.int64) << 43) | (tag.astype(np.int64) << 42) | (np.minimum(q, _MOST) << 22) | (np.minimum(g, _MOST) << 2)
        rr, cc = np.nonzero(pool & (worth > 0))
        worth = worth[rr, cc] | (same_source[rr, cc].astype(np.int64) << 1) | same_category[rr, cc]
        away = np.abs(np.array([np.nan if s is None else s for s in seconds], dtype=float)[rr] - self.published[cc])
        away[np.isnan(away)] = np.inf
        ids = values(pa.array(aid))[rr]
        made = np.array([-(1 << 62) if c is None else c for c in created], dtype=np.int64)[rr]
        new = [cc, -worth, away, -made, ids, q[rr, cc], g[rr, cc], top[rr, cc], tag[rr, cc], same_source[rr, cc], same_category[rr, cc]]
        both = new if self.best is None else [np.concatenate([a, b]) for a, b in zip(self.best, new, strict=True)]
        order = np.lexsort((both[4], both[3], both[2], both[1], both[0]))
        both = [x[order] for x in both]
        rank = np.arange(len(order)) - np.searchsorted(both[0], both[0])
        self.best = [x[rank < self.n] for x in both]


def best_articles(articles: DataFrame, cases: DataFrame, n: int) -> DataFrame:
    """(case_id, article_id, counts and flags) of the rows that may be among the best ``n`` per case.

    ``articles`` has article_id, source_id, category, title, body (both in
    lower case), published_at and created_at; ``cases`` has case_id,
    primary_article_id, p_source, p_category, p_word, p_published, terms
    (structs of term, q, g, t), retrieved and known (article ids).  Rows are
    ordered by retrieved, tag, question terms, evidence terms, source,
    category, distance in time, newest and id.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = articles.select("article_id", "source_id", "category", "title", "body", seconds("published_at").alias("seconds"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"))
    block = cases.select("case_id", "primary_article_id", "p_source", "p_category", "p_word", seconds("p_published").alias("p_seconds"), "terms", "retrieved", "known")
    width, names = len(rows.columns), block.columns
    schema = T.StructType([cases.schema["case_id"], articles.schema["article_id"]])
    for name in ("question_overlap_terms", "gold_title_overlap_terms"):
        schema = schema.add(name, T.LongType())
    for name in ("appeared_in_top_k", "strong_entity_tag_shared", "same_source", "same_category"):
        schema = schema.add(name, T.BooleanType())

    def run(batches):
        held: dict = {}

        def out(case_set: _Cases) -> pa.RecordBatch:
            best = case_set.best
            case_ids = pa.array([case_set.ids[c] for c in best[0].tolist()])
            return pa.RecordBatch.from_arrays([case_ids, pa.array(best[4]), *[pa.array(x) for x in best[5:]]], names=schema.names)

        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(width)[r].values
                key = (len(ids), ids[0].as_py(), ids[-1].as_py())
                if key not in held:
                    if len(held) >= HELD and (old := held.pop(next(iter(held)))).best is not None:
                        yield out(old)
                    held[key] = _Cases({name: batch.column(width + i)[r].as_py() for i, name in enumerate(names)}, n)
                held[key].add(*[batch.column(i)[r].as_py() for i in range(width)])
        for case_set in held.values():
            if case_set.best is not None:
                yield out(case_set)

    return _packed(rows, BLOCK_ROWS).crossJoin(_packed(block, BLOCK_CASES)).mapInArrow(run, schema)
