"""Reciprocal rank fusion of full-text and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import fulltext, vector

RRF_K = 60


def ranked(df: DataFrame, score: str, key: str = "id") -> DataFrame:
    """Adds ``rank``, from 1, by score descending then key. For short lists only: the
    window has one partition (callers limit to at most 512 rows or the page asked for)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(*lists: DataFrame, key: str = "id") -> DataFrame:
    """(key, score): the sum of 1/(60 + rank) over ranked lists (key, rank)."""
    parts = [x.select(F.col(key), (1.0 / (RRF_K + F.col("rank"))).alias("part")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy(key).agg(F.sum("part").alias("score"))


def hybrid(notes: DataFrame, chunks: DataFrame, query: str, query_vector: list[float], type_: str | None = None, limit: int = 10) -> DataFrame:
    """id, path, type, title, score, bm25_score, similarity, snippet by fused rank."""
    if limit < 1:
        raise ValueError("limit must be positive")
    depth = max(5 * limit, 50)
    lexical = ranked(fulltext.search(notes, query, type_, depth), "score")
    hits = vector.best_chunk(vector.nearest(chunks, query_vector, min(max(depth, 50), 512)))
    near = F.broadcast(hits).join(notes.select("id", "path", "type", "title"), F.col("note_id") == F.col("id"))
    if type_ is not None:
        near = near.where(F.col("type") == type_)
    near = ranked(near.select("id", "path", "type", "title", "similarity", "chunk_text"), "similarity")
    left = lexical.select("id", *(F.col(c).alias(f"l_{c}") for c in ("path", "type", "title", "score", "rank")))
    right = near.select("id", *(F.col(c).alias(f"v_{c}") for c in ("path", "type", "title", "similarity", "chunk_text", "rank")))
    joined = left.join(right, "id", "full")
    score = F.coalesce(1.0 / (RRF_K + F.col("l_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("v_rank")), F.lit(0.0))
    top = joined.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)
    text = F.when(F.col("v_chunk_text").isNotNull(), vector.snippet_column("v_chunk_text"))
    return top.select(
        "id",
        F.coalesce("l_path", "v_path").alias("path"),
        F.coalesce("l_type", "v_type").alias("type"),
        F.coalesce("l_title", "v_title").alias("title"),
        "score",
        F.col("l_score").alias("bm25_score"),
        F.col("v_similarity").alias("similarity"),
        text.alias("snippet"),
    )
