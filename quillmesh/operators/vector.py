"""Exact nearest neighbours by cosine, and notes similar to a query.

The query vector is small and constant; the scan is the cost. Batches of vectors go
to numpy through Arrow (one matrix product a batch); top k is per partition first
(TakeOrderedAndProject). A zero vector has similarity 0. Ties: note_id, then seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(chunks: DataFrame, query: list[float], vector_col: str = "vector") -> DataFrame:
    """``chunks`` (without the vector) plus similarity = 1 - cosine distance; rows
    whose vector has another length raise."""
    q = np.asarray(query, np.float64)
    norm = float(np.linalg.norm(q))
    keep = [c for c in chunks.columns if c != vector_col]
    schema = T.StructType([chunks.schema[c] for c in keep] + [T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(vector_col)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != len(q) * batch.num_rows or len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
                raise ValueError(f"a vector doesn't have {len(q)} dimensions")
            matrix = flat.reshape(batch.num_rows, len(q))
            norms = np.linalg.norm(matrix, axis=1) * norm
            found = np.divide(matrix @ q, norms, out=np.zeros(len(norms)), where=norms > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, "similarity"])

    return chunks.select(*keep, vector_col).mapInArrow(run, schema)


def nearest(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest chunks: note_id, seq, chunk_text, similarity."""
    found = similarity(chunks.select("note_id", "seq", "chunk_text", "vector"), query)
    return found.orderBy(F.desc("similarity"), "note_id", "seq").limit(k)


def best_chunk(hits: DataFrame) -> DataFrame:
    """One row per note, its nearest chunk (the first of equals)."""
    order = Window.partitionBy("note_id").orderBy(F.desc("similarity"), "seq")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def overfetch(limit: int) -> int:
    """Chunks to fetch for ``limit`` notes, before notes are told apart."""
    return min(max(8 * limit, 50), 512)


def snippet_column(text_col: str, limit: int = 280):
    """Trimmed text of at most ``limit`` UTF-8 bytes, a cut marked with an ellipsis."""
    from quillmesh.functions.text import snippet

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, limit))

    return cut(F.col(text_col))


def similar(notes: DataFrame, chunks: DataFrame, query: list[float], type_: str | None = None, limit: int = 10) -> DataFrame:
    """Notes by their best chunk: id, path, type, title, score, chunk_seq, snippet.
    Deleted notes drop out; the type is filtered after the fetch."""
    if limit < 1:
        raise ValueError("limit must be positive")
    hits = best_chunk(nearest(chunks, query, overfetch(limit)))
    found = F.broadcast(hits).join(notes.select("id", "path", "type", "title"), F.col("note_id") == F.col("id"))  # at most 512 rows
    if type_ is not None:
        found = found.where(F.col("type") == type_)
    top = found.orderBy(F.desc("similarity"), "id").limit(limit)
    return top.select("id", "path", "type", "title", F.col("similarity").alias("score"), F.col("seq").alias("chunk_seq"), snippet_column("chunk_text").alias("snippet"))
