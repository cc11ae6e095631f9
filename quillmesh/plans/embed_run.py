"""Bringing the embeddings table up to date with the notes table."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import functions as F

from quillmesh.catalog import Vault
from quillmesh.functions.chunker import MAX_BYTES, OVERLAP_BYTES
from quillmesh.functions.embedders import Embedder, select_embedder
from quillmesh.operators import notes as ops
from quillmesh.operators.chunks import embed_notes
from quillmesh.schemas import EMBEDDINGS
from quillmesh.sources.snapshots import read_json, write_json


@dataclass
class EmbedStats:
    scanned: int = 0
    embedded: int = 0
    unchanged: int = 0
    removed: int = 0
    chunks_written: int = 0
    total_chunks: int = 0
    model: str = ""
    full: bool = False
    elapsed_ms: int = 0

    as_dict = asdict


def run_embed(vault: Vault, embedder: Embedder | None = None, full: bool = False) -> EmbedStats:
    """Embed notes that are new or changed, drop removed ones; everything if the
    model or chunk sizes differ from those the table was made with. When nothing is
    to do the model isn't touched."""
    began, store = time.time(), vault.store
    vault.require_indexed()
    embedder = embedder or select_embedder()
    meta = {"model": embedder.model_id, "dim": embedder.dim, "chunk_max_bytes": MAX_BYTES, "overlap_bytes": OVERLAP_BYTES}
    have = store.exists("embeddings")
    full = full or (have and read_json(vault.embed_meta_path) != meta)
    notes = vault.notes()
    before = store.read("embeddings", EMBEDDINGS)
    state = before.select(F.col("note_id").alias("id"), "content_hash").distinct()
    status = ops.diff_state(state.limit(0) if full else state, notes, "id", "content_hash").persist()
    try:
        n = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        todo = status.where("status IN ('added', 'changed')").select("id")
        embedded = n.get("added", 0) + n.get("changed", 0)
        removed = n.get("removed", 0)
        written = 0
        if embedded or removed or (full and have):
            owners = status.where("status <> 'same'").select(F.col("id").alias("note_id"))
            stamp = int(time.time() * 1000)
            fresh = embed_notes(notes.join(todo, "id", "left_semi"), embedder, stamp)
            parts = None if full else store.touched(owners)
            table = fresh if full else ops.replace_owned(store.read("embeddings", EMBEDDINGS, parts), owners, fresh, "note_id")
            store.commit({"embeddings": table.select(*EMBEDDINGS.names)}, parts)
            write_json(vault.embed_meta_path, meta)
            written = store.read("embeddings", EMBEDDINGS, parts).where(F.col("embedded_at_ms") == stamp).count()
        total = store.read("embeddings", EMBEDDINGS).count()
    finally:
        status.unpersist()
    return EmbedStats(
        scanned=sum(n.values()) - removed,
        embedded=embedded,
        unchanged=n.get("same", 0),
        removed=removed,
        chunks_written=written,
        total_chunks=total,
        model=embedder.model_id,
        full=full,
        elapsed_ms=int((time.time() - began) * 1000),
    )
