"""Notes and edges as tables: lookups, neighbours, ontology, resolution, upserts.

Everything is DataFrame to DataFrame and lazy; filters and column lists reach the
Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import basename, normal_target, note_id


def get_note(notes: DataFrame, wanted: str, body: bool = False) -> DataFrame:
    """The note of an id (or path): id, path, type, title, frontmatter[, body]."""
    columns = ["id", "path", "type", "title", F.col("frontmatter_json").alias("frontmatter"), *(["body"] if body else [])]
    return notes.where(F.col("id") == note_id(F.lit(wanted))).select(*columns).limit(1)


def links(edges: DataFrame, of: str, edge_type: str | None = None) -> DataFrame:
    """Outgoing edges of a note by (edge_type, position); none for unknown ids."""
    found = edges.where(F.col("from_id") == note_id(F.lit(of)))
    if edge_type is not None:
        found = found.where(F.col("edge_type") == edge_type)
    return found.select("edge_type", "to_id", "to_alias", "resolved", "position").orderBy("edge_type", "position")


def backlinks(edges: DataFrame, notes: DataFrame, to: str, edge_type: str | None = None) -> DataFrame:
    """Incoming edges with their source's type and title (null where the source is
    unknown), by (edge_type, from_id)."""
    found = edges.where(F.col("to_id") == note_id(F.lit(to)))
    if edge_type is not None:
        found = found.where(F.col("edge_type") == edge_type)
    sources = notes.select(F.col("id").alias("from_id"), F.col("type").alias("from_type"), F.col("title").alias("from_title"))
    return found.select("edge_type", "from_id").join(sources, "from_id", "left").select(
        "edge_type", "from_id", "from_type", "from_title"
    ).orderBy("edge_type", "from_id")


def type_counts(notes: DataFrame) -> DataFrame:
    """Notes per type, by name; untyped notes aren't listed."""
    return notes.where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy("type")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("count")).orderBy("edge_type")


def edge_totals(edges: DataFrame) -> DataFrame:
    """One row: all edges, and those without a target note."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("resolved")).alias("unresolved"))


def resolve_links(raw: DataFrame, live_ids: DataFrame) -> DataFrame:
    """Targets of raw edges (from_id, edge_type, to_raw, to_alias, position): the id
    itself, else the only id of that base name, else the normalised text.

    Two left equi-joins; Catalyst broadcasts the id tables while they are small.
    """
    live = live_ids.select(F.col("id").alias("_id")).distinct()
    single = live.groupBy(basename(F.col("_id")).alias("_base")).agg(F.min("_id").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    wanted = raw.withColumn("_to", normal_target(F.col("to_raw")))
    joined = wanted.join(live, F.col("_to") == F.col("_id"), "left").join(single, basename(F.col("_to")) == F.col("_base"), "left")
    return joined.select(
        "from_id",
        "edge_type",
        F.coalesce("_id", "_only", "_to").alias("to_id"),
        "to_raw",
        "to_alias",
        (F.col("_id").isNotNull() | F.col("_only").isNotNull()).alias("resolved"),
        "position",
    )


def explode_links(parsed: DataFrame) -> DataFrame:
    """Raw edges, one row each, of parsed notes (id, links)."""
    each = parsed.select(F.col("id").alias("from_id"), F.explode("links").alias("e"))
    return each.select("from_id", "e.edge_type", "e.to_raw", "e.to_alias", "e.position")


def upsert(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``fresh``, and those of ``prior`` whose key it doesn't have."""
    return prior.join(fresh.select(key), key, "left_anti").select(*prior.columns).unionByName(fresh.select(*prior.columns))


def delete_keys(prior: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``prior`` without the keys of ``gone`` (a column of the same name)."""
    return prior.join(gone.select(key), key, "left_anti").select(*prior.columns)


def replace_owned(prior: DataFrame, owners: DataFrame, fresh: DataFrame, owner: str) -> DataFrame:
    """All rows of ``owners`` go, the fresh ones come."""
    return delete_keys(prior, owners, owner).unionByName(fresh.select(*prior.columns))


def diff_state(prior: DataFrame, now: DataFrame, key: str, *stamps: str) -> DataFrame:
    """(key, status) over both tables: added, removed, changed or same by stamps."""
    p = prior.select(F.col(key).alias("_p"), *(F.col(s).alias(f"_p_{s}") for s in stamps))
    n = now.select(F.col(key).alias("_n"), *(F.col(s).alias(f"_n_{s}") for s in stamps))
    same: Column = F.lit(True)
    for s in stamps:
        same = same & F.col(f"_p_{s}").eqNullSafe(F.col(f"_n_{s}"))
    status = F.when(F.col("_p").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "same").otherwise("changed")
    return p.join(n, F.col("_p") == F.col("_n"), "full").select(F.coalesce("_n", "_p").alias(key), status.alias("status"))
