"""SimHash near-duplicates, found through pivot distance tables.

Fingerprint: words of the text (A-Z lower-cased), k-word shingles with repeats,
XXH64 (seed 42) of each; a bit is 1 if set in over half the hashes; no words: 0.

Links (Hamming distance up to 2): every distinct fingerprint gets a pivot table,
its Hamming distances to ``N_PIVOTS`` reference fingerprints, kept per 16-bit
band (the four parts of a reference sum to the plain distance). A coordinate
differs by no more than the fingerprints do, so a pair at distance 2 agrees in
*all* coordinates of at least two of the four bands: the six pairs of bands give
the buckets in which candidates are looked for, with nothing lost. In a bucket,
pairs whose largest coordinate difference exceeds 2 are discarded and the
survivors verified by exact distance.

Bounded work: copies collapse to one fingerprint first; a bucket of up to
``max_bucket`` members is compared in slices inside a task and gives only the
edges of a spanning forest, never all pairs; members of larger buckets are linked
exactly by a second rule (fingerprints within 2 share a neighbour at distance up
to 1, of which each has 65, and a neighbour has at most 65 fingerprints).

Nulls and empty texts have fingerprint zero and link like any other. Rows with a
null id keep their fingerprint; their component is the smallest id reached (null
if there is none). Repeated rows are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, lean
from quillmesh.llm.components import connected_components
from quillmesh.llm.shingles import shingle_hashes

N_PIVOTS, N_BANDS, BAND_BITS, MAX_DISTANCE = 16, 4, 16, 2


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), k)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "key"][: batch.num_columns])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, key_col: str | None = None) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed long of the same bits; with
    the long ``key_col``: (doc_id, fp, key)."""
    keys = [F.col(key_col).cast("long").alias("key")] if key_col else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keys)
    return source.mapInArrow(lean(_fingerprints(k)), "doc_id bigint, fp bigint" + ", key bigint" * len(keys))


def pivot_tables(seed: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each band and 16-bit value: its distances to the references' bands
    (band, value, pivot), and a 64-bit key of all of these distances."""
    rng = np.random.default_rng(seed)
    references = rng.integers(0, 1 << BAND_BITS, (N_BANDS, N_PIVOTS), np.int64)
    values = np.arange(1 << BAND_BITS, dtype=np.int64)
    distances = np.bitwise_count(values[None, :, None] ^ references[:, None, :]).astype(np.int8)
    keys = np.zeros((N_BANDS, 1 << BAND_BITS), np.uint64)
    for pivot in range(N_PIVOTS):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + distances[:, :, pivot].astype(np.uint64) + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    return distances, keys


def _bands(fps: np.ndarray) -> np.ndarray:
    u = fps.view(np.uint64)
    return np.stack([(u >> np.uint64(BAND_BITS * b)) & np.uint64(0xFFFF) for b in range(N_BANDS)]).astype(np.int64)


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, keys = pivot_tables()
    pairs = [(i, j) for i in range(N_BANDS) for j in range(i + 1, N_BANDS)]
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        bands = _bands(fps)
        of = [keys[b][bands[b]] for b in range(N_BANDS)]
        for n, (i, j) in enumerate(pairs):
            mixed = (of[i] * np.uint64(0xC2B2AE3D27D4EB4F) + of[j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            mixed ^= mixed >> np.uint64(31)
            yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(fps)], ["key", "fp"])


def link_bucket(fps: np.ndarray, coordinates: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    n = len(fps)
    root = np.arange(n)
    edges = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    u = fps.view(np.uint64)
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        for pivot in range(coordinates.shape[1]):  # the largest coordinate difference decides
            near = near[np.abs(coordinates[near, pivot] - coordinates[i, pivot]) <= MAX_DISTANCE]
            if not len(near):
                break
        for j in near[np.bitwise_count(u[near] ^ u[i]) <= MAX_DISTANCE].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(fps[i]), int(fps[j])))
    return edges


def _link_sorted(max_bucket: int):
    """Over rows sorted by key: the links of each bucket, or, of a larger one, its
    members as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances, _ = pivot_tables()

        def links(fps: np.ndarray) -> tuple[list, list]:
            if len(fps) > max_bucket:
                return fps.tolist(), [None] * len(fps)
            bands = _bands(fps)
            coordinates = np.concatenate([distances[b][bands[b]] for b in range(N_BANDS)], axis=1)
            found = link_bucket(fps, coordinates.astype(np.int16))
            return [a for a, _ in found], [b for _, b in found]

        def out(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held_key, held, large = None, np.zeros(0, np.int64), False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else [0]
            sizes = np.diff(bounds)
            last = len(sizes) - 1
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last)).tolist():
                key, members = keys[bounds[g]], fps[bounds[g] : bounds[g + 1]]
                if key == held_key:
                    members = np.concatenate((held, members))
                elif len(held) > 1 or large and len(held):
                    yield out(held.tolist(), [None] * len(held)) if large else out(*links(held))
                    large = False
                else:
                    large = False
                held_key, held = key, members
                if len(held) > max_bucket:  # hand the members on, keep none
                    yield out(held.tolist(), [None] * len(held))
                    held, large = held[:0], True
        if len(held) > 1 or large and len(held):
            yield out(held.tolist(), [None] * len(held)) if large else out(*links(held))

    return run


def _neighbour_links(fps: DataFrame) -> DataFrame:
    """(a, b): links among the given fingerprints by shared neighbours."""
    shared = (
        fps.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1).cast("long") if not i else F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")) for i in range(64)))).alias("key"))
        .groupBy("key")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def fingerprint_links(distinct: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within distance 2."""
    bucketed = distinct.select("fp").mapInArrow(lean(_bucket_keys), "key bigint, fp bigint")
    sorted_rows = bucketed.repartition("key").sortWithinPartitions("key", "fp")
    found = cut(sorted_rows.mapInArrow(lean(_link_sorted(max_bucket)), "a bigint, b bigint"))
    rest = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return found.where("b IS NOT NULL").union(_neighbour_links(rest))


def _with_component(distinct: DataFrame, max_bucket: int) -> DataFrame:
    """``distinct`` (by fp) with the fingerprint that names its component."""
    linked = connected_components(fingerprint_links(distinct, max_bucket))
    linked = linked.select(F.col("node").alias("fp"), "component")
    return distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def one_per_component(
    docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bucket: int = 4096
) -> DataFrame:
    """(doc_id, key): of each component the row of the smallest (doc_id, ``key_col``),
    null ids last; rows of different components may have the same id."""
    marked = cut(fingerprints(docs, id_col, text_col, k, key_col))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    distinct = cut(marked.groupBy("fp").agg(F.min(order).alias("least")))
    least = _with_component(distinct, max_bucket).groupBy("component").agg(F.min("least").alias("least"))
    return least.select("least.doc_id", "least.key")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bucket: int = 4096
) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for every row: 16 hex digits,
    the smallest id linked directly or through others, and how many rows have the
    same fingerprint."""
    marked = cut(fingerprints(docs, id_col, text_col, k))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    members = _with_component(distinct, max_bucket)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(least, "component").select("fp", "component_id", "copies")
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies"
    )
