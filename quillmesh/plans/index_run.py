"""Indexing a folder of notes into the notes and edges tables, incrementally."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import Vault
from quillmesh.functions.text import note_id
from quillmesh.operators import fulltext
from quillmesh.operators import notes as ops
from quillmesh.schemas import EDGES, NOTES
from quillmesh.sources.snapshots import write_json
from quillmesh.sources.vault_files import list_files, read_and_parse


@dataclass
class IndexStats:
    scanned: int = 0
    added: int = 0
    updated: int = 0
    removed: int = 0
    unchanged: int = 0
    edges: int = 0
    unresolved: int = 0
    elapsed_ms: int = 0

    as_dict = asdict


def plan_index(files: DataFrame, prior: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, status): added, updated, touched (only stamps differ), skipped (stamps as
    before, not read), unreadable (listed, not parsed) or removed."""
    live = files.select(note_id(F.col("rel")).alias("_live"), F.col("mtime_ms").alias("_m"), F.col("size_bytes").alias("_s"))
    before = prior.select(F.col("id").alias("_prior"), F.col("content_hash").alias("_h"), F.col("mtime_ms").alias("_pm"), F.col("size_bytes").alias("_ps"))
    now = parsed.select(F.col("id").alias("_id"), F.col("content_hash").alias("_nh"))
    all_ids = live.join(before, F.col("_live") == F.col("_prior"), "full").join(now, F.col("_live") == F.col("_id"), "left")
    status = (
        F.when(F.col("_live").isNull(), "removed")
        .when(F.col("_prior").isNotNull() & (F.col("_m") == F.col("_pm")) & (F.col("_s") == F.col("_ps")), "skipped")
        .when(F.col("_id").isNull(), "unreadable")
        .when(F.col("_prior").isNull(), "added")
        .when(F.col("_h") == F.col("_nh"), "touched")
        .otherwise("updated")
    )
    return all_ids.select(F.coalesce("_live", "_prior").alias("id"), status.alias("status"))


def candidates(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files whose stamps differ from the stored ones, or that are new."""
    p = prior.select(F.col("id").alias("_prior"), F.col("mtime_ms").alias("_pm"), F.col("size_bytes").alias("_ps"))
    same = (F.col("mtime_ms") == F.col("_pm")) & (F.col("size_bytes") == F.col("_ps"))
    return files.join(p, note_id(F.col("rel")) == F.col("_prior"), "left").where(~F.coalesce(same, F.lit(False))).select(*files.columns)


def run_index(vault: Vault, full: bool = False, re_resolve: bool = False, postings: bool = False) -> IndexStats:
    """Bring the tables up to date with the folder; both become current at once. Only
    parts of the tables that have a changed note are read whole and written.

    Links are resolved when their source changes; with ``re_resolve`` all links are
    resolved against the new set of ids, with ``postings`` the inverted index is
    stored too.
    """
    began, spark, store = time.time(), vault.spark, vault.store
    prior = store.read("notes", NOTES)
    if full or prior.isEmpty():
        prior, full = spark.createDataFrame([], NOTES), True
    files = list_files(spark, vault.source).persist()
    parsed = read_and_parse(candidates(files, prior), vault.source).persist()
    status = plan_index(files, prior, parsed).persist()
    try:
        n = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        moved = status.where("status IN ('added', 'updated', 'touched', 'removed')").select("id")
        parts = None if full or re_resolve else store.touched(moved)
        if parts is None or parts or not store.exists("notes"):
            now = F.lit(int(time.time() * 1000))
            rows = parsed.withColumn("indexed_at_ms", now).select(*NOTES.names)
            gone = status.where("status = 'removed'").select("id")
            old_notes = prior if full else store.read("notes", NOTES, parts)
            notes = ops.upsert(ops.delete_keys(old_notes, gone, "id"), rows, "id")
            owners = status.where("status IN ('added', 'updated', 'removed')").select(F.col("id").alias("from_id"))
            changed = parsed.join(status.where("status IN ('added', 'updated')"), "id", "left_semi")
            live = files.select(note_id(F.col("rel")).alias("id"))
            fresh = ops.resolve_links(ops.explode_links(changed), live)
            old_edges = spark.createDataFrame([], EDGES) if full else store.read("edges", EDGES, parts)
            edges = ops.replace_owned(old_edges, owners, fresh, "from_id")
            if re_resolve:
                edges = ops.resolve_links(edges.select("from_id", "edge_type", "to_raw", "to_alias", "position"), live)
            store.commit({"notes": notes, "edges": edges.select(*EDGES.names)}, parts)
            save_ontology(vault)
        if postings and not vault.has_postings():
            save_postings(vault)
        total = ops.edge_totals(store.read("edges", EDGES)).first()
    finally:
        for df in (files, parsed, status):
            df.unpersist()
    return IndexStats(
        scanned=sum(n.values()) - n.get("removed", 0),
        added=n.get("added", 0),
        updated=n.get("updated", 0),
        removed=n.get("removed", 0),
        unchanged=n.get("skipped", 0) + n.get("touched", 0),
        edges=total.edges,
        unresolved=total.unresolved,
        elapsed_ms=int((time.time() - began) * 1000),
    )


def save_ontology(vault: Vault) -> None:
    """Types and edge types with their counts, read later without a scan."""
    types = {r.type: r["count"] for r in ops.type_counts(vault.notes()).collect()}
    edge_types = {r.edge_type: r["count"] for r in ops.edge_type_counts(vault.edges()).collect()}
    write_json(vault.ontology_path, {"types": types, "edge_types": edge_types, "indexed_at_ms": int(time.time() * 1000)})


def save_postings(vault: Vault) -> None:
    """Store the inverted index and its field statistics. They are used while the
    notes snapshot that they were made from is the current one."""
    snapshot, notes = vault.store.current()["notes"], vault.notes()
    index = fulltext.postings(notes).repartition("term").sortWithinPartitions("term")  # row groups by term: reads are pruned
    vault.store.commit({"postings": index, "fields": fulltext.corpus_stats(notes)})
    write_json(vault.postings_path, {"notes": snapshot})
