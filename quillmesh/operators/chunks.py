"""Chunks of notes and their vectors.

A task goes through Spark's Arrow batches (10,000 rows unless the session's settings say
less) a row at a time and hands on small groups of rows, so that besides one batch
Python's memory doesn't grow with the rows. Notes are cut and embedded in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.functions.chunker import chunk_markdown
from quillmesh.functions.embedders import BATCH, Embedder
from quillmesh.functions.memory import groups, lean
from quillmesh.schemas import DIM

_NOTE = ("id", "title", "body", "content_hash")
_CHUNK = ("note_id", "seq", "content_hash", "title", "chunk_text")
_EMBEDDED = "note_id string, seq int, content_hash string, chunk_text string, vector array<float>, embedded_at_ms bigint"
_ROWS = 1000  # chunks a group, unless their texts are long


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows as tuples; a batch is let go before the next one is read."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in columns)
        del batch, columns


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The notes' chunks as tuples of _CHUNK."""
    for note_id, title, body, content_hash in _rows(batches, _NOTE):
        for seq, text in enumerate(chunk_markdown(body) or [title]):
            yield note_id, seq, content_hash, title, text


def _grouped(chunks: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    return groups(chunks, most, lambda c: len(c[-1] or ""))


def _strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def _embed(chunks: Iterable[tuple], embedder: Embedder, stamp_ms: int) -> Iterator[pa.RecordBatch]:
    for group in _grouped(chunks, BATCH):
        ids, seqs, hashes, titles, texts = zip(*group)
        vectors = embedder.embed_documents(list(zip(titles, texts)))
        if vectors.shape != (len(group), DIM):
            raise ValueError(f"the model gave vectors of shape {vectors.shape}, {DIM} dimensions are wanted")
        flat = pa.array(np.asarray(vectors, np.float32).reshape(-1))
        at = pa.array(np.arange(0, len(flat) + 1, DIM, dtype=np.int32))
        columns = [_strings(ids), pa.array(seqs, pa.int32()), _strings(hashes), _strings(texts), pa.ListArray.from_arrays(at, flat), pa.array([stamp_ms] * len(group), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["note_id", "seq", "content_hash", "chunk_text", "vector", "embedded_at_ms"])


def chunk_notes(notes: DataFrame) -> DataFrame:
    """(note_id, seq, content_hash, title, chunk_text) of notes (id, title, body,
    content_hash); a blank body is one chunk, the title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(_cut(batches), _ROWS):
            ids, seqs, hashes, titles, texts = zip(*group)
            yield pa.RecordBatch.from_arrays([_strings(ids), pa.array(seqs, pa.int32()), _strings(hashes), _strings(titles), _strings(texts)], list(_CHUNK))

    return notes.select(*_NOTE).mapInArrow(lean(run), "note_id string, seq int, content_hash string, title string, chunk_text string")


def embed_chunks(chunks: DataFrame, embedder: Embedder, stamp_ms: int) -> DataFrame:
    """Rows of the embeddings table; the model runs in batches on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _embed(_rows(batches, _CHUNK), embedder, stamp_ms)

    return chunks.select(*_CHUNK).mapInArrow(lean(run), _EMBEDDED)


def embed_notes(notes: DataFrame, embedder: Embedder, stamp_ms: int) -> DataFrame:
    """``embed_chunks`` of ``chunk_notes``, in one pass of Python: half the workers, and
    the texts go there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _embed(_cut(batches), embedder, stamp_ms)

    return notes.select(*_NOTE).mapInArrow(lean(run), _EMBEDDED)
