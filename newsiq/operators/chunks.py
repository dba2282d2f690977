"""Article chunks: splitting, annotation, backfill, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsiq.functions import text as tx
from newsiq.functions.stats import count_if

CHUNKING_VERSION = "paragraph-window-v1"


def split_chunks(text: Column | str, target: int = 3200, overlap: int = 600, sep: str = r"\n{2,}") -> Column:
    """Array of (chunk_text, char_start, char_end) of one text.

    Paragraphs are packed up to ``target`` characters; when the next one would
    overflow, the chunk is emitted and its last ``overlap`` characters open the
    next one.  A paragraph longer than ``target`` stays whole.  Offsets follow
    the packed text, whose paragraphs are joined by one blank line, so
    ``char_end`` is ``char_start`` plus the chunk length.
    """
    x = F.coalesce(tx._c(text), F.lit(""))
    trim = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(x, sep), trim), lambda p: p != "")
    empty = F.array().cast("array<struct<chunk_text:string,char_start:int,char_end:int>>")
    state = F.struct(
        F.lit("").alias("buffer"), F.lit(0).alias("start"), F.lit(0).alias("cursor"), empty.alias("done")
    )

    def chunk(buffer: Column, start: Column) -> Column:
        return F.struct(
            buffer.alias("chunk_text"), start.cast("int").alias("char_start"), (start + F.length(buffer)).cast("int").alias("char_end")
        )

    def step(acc: Column, p: Column) -> Column:
        buffer, begun = acc["buffer"], acc["buffer"] != ""
        at = F.call_function("locate", p, x, acc["cursor"] + 1) - 1
        joined = F.when(begun, F.concat(buffer, F.lit("\n\n"), p)).otherwise(p)
        full = begun & (F.length(joined) > target)
        tail = F.right(buffer, F.lit(overlap))
        return F.struct(
            F.when(full, F.concat(tail, F.lit("\n\n"), p)).otherwise(joined).alias("buffer"),
            F.when(full, F.greatest(F.lit(0), at - F.length(tail))).when(~begun, at).otherwise(acc["start"]).cast("int").alias("start"),
            (at + F.length(p)).cast("int").alias("cursor"),
            F.when(full, F.concat(acc["done"], F.array(chunk(buffer, acc["start"])))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["buffer"] != "", F.concat(acc["done"], F.array(chunk(acc["buffer"], acc["start"])))).otherwise(acc["done"])

    return F.aggregate(parts, state, step, finish)


def annotate(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Language flag, token estimate and hash of a text column."""
    return df.select(
        "*",
        tx.language(text).alias("language"),
        F.ceil(F.length(text) / 4).cast("long").alias("token_estimate"),
        F.sha2(text, 256).alias("chunk_hash"),
    )


def build(
    articles: DataFrame, text: str = "article_content", id_col: str = "article_id",
    target: int = 3200, overlap: int = 600, sep: str = r"\n{2,}", version: str = CHUNKING_VERSION,
) -> DataFrame:
    """Chunk rows of every article, unique per (article, version, hash).

    Repeated chunks of one article keep the last position, as an upsert in
    chunk order would.
    """
    rows = articles.select(id_col, F.posexplode(split_chunks(text, target, overlap, sep)).alias("chunk_index", "_c"))
    rows = annotate(rows.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), "_c.*"))
    rows = rows.withColumn("chunking_version", F.lit(version)).withColumn("boundary_type", F.lit("paragraph"))
    cols = rows.columns
    keep = F.max_by(F.struct(*cols), "chunk_index").alias("_r")
    return rows.groupBy(id_col, "chunking_version", "chunk_hash").agg(keep).select("_r.*")


def embedding_input(content: Column | str, summary: Column | str, cap: int = 2000) -> Column:
    """Content if there is any, else the summary, cut to ``cap``."""
    return F.substring(F.coalesce(F.nullif(tx._c(content), F.lit("")), tx._c(summary), F.lit("")), 1, cap)


def sanitized_inputs(df: DataFrame, text: str, cap: int = 2500) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejects): sanitised text, rows with nothing left rejected."""
    out = df.withColumn("embedding_input", tx.sanitize_for_embedding(text, cap))
    return out.where(F.col("embedding_input") != ""), out.where(F.col("embedding_input") == "")


def pending_embeddings(articles: DataFrame, limit: int = 45) -> DataFrame:
    """Newest rows without a vector; the batch size is the feature."""
    return (
        articles.where(F.col("embedding").isNull())
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
    )


def backfill_targets(
    articles: DataFrame, gold: DataFrame | None = None, newest: int | None = None, min_chars: int | None = None
) -> DataFrame:
    """Articles to chunk: approved relevant gold, or the ``newest`` ones, long enough."""
    has = articles.where(F.col("article_content").isNotNull())
    if gold is not None:
        wanted = gold.where((F.col("review_status") == "approved") & (F.col("relevance_grade") >= 2))
        has = has.join(wanted.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
        least = 200 if min_chars is None else min_chars
    else:
        least = 5000 if min_chars is None else min_chars
        has = has.orderBy(F.col("created_at").desc(), F.col("id").desc())
        has = has.limit(newest) if newest is not None else has
    return has.where(F.length("article_content") >= least)


def coverage(chunks: DataFrame, model: str) -> DataFrame:
    """Chunk and embedded-chunk counts per (article, version)."""
    return chunks.groupBy("article_id", "chunking_version").agg(
        F.count("*").alias("chunk_count"),
        count_if((F.col("embedding_model") == model) & F.col("embedding").isNotNull()).alias("embedded_chunk_count"),
    )


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, dim: int, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, rejected vectors of another length)."""
    good = vectors.where(F.size("embedding") == dim)
    bad = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)
    return chunks.join(good, key, "left"), bad
