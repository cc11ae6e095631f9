"""Notes from a stream: micro-batches are parsed and upserted like an index run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.catalog import Vault
from quillmesh.operators import notes as ops
from quillmesh.schemas import EDGES, NOTES
from quillmesh.sources.vault_files import parse_contents


def apply_batch(vault: Vault, contents: DataFrame) -> None:
    """Upsert one batch of (rel, content, mtime_ms, size_bytes): of a note's versions
    the last stays, its outgoing links are replaced. Applying a batch again changes
    nothing, so a restarted stream may repeat it. Only parts with one of its notes are
    written."""
    latest = contents.groupBy("rel").agg(F.max_by(F.struct("content", "mtime_ms", "size_bytes"), "mtime_ms").alias("v"))
    parsed = parse_contents(latest.select("rel", "v.*")).persist()
    try:
        rows = parsed.withColumn("indexed_at_ms", F.col("mtime_ms")).select(*NOTES.names)
        store = vault.store
        parts = store.touched(parsed.select("id"))
        notes = ops.upsert(store.read("notes", NOTES, parts), rows, "id")
        live = store.read("notes", NOTES).select("id").union(parsed.select("id"))
        fresh = ops.resolve_links(ops.explode_links(parsed), live)
        owners = parsed.select(F.col("id").alias("from_id"))
        edges = ops.replace_owned(store.read("edges", EDGES, parts), owners, fresh, "from_id")
        store.commit({"notes": notes, "edges": edges}, parts)
    finally:
        parsed.unpersist()


def ingest(vault: Vault, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start a query that applies every micro-batch of ``stream``."""
    return stream.writeStream.foreachBatch(lambda df, _: apply_batch(vault, df)).option("checkpointLocation", checkpoint).start()
