"""Benchmark decontamination: which documents contain a test item.

Contained: at least ``threshold`` of an item's distinct k-word shingles occur in
the document. The search is by MinHash sketches in size partitions:

- Items are partitioned by size (number of shingles, doubling bounds). An item's sketch is
  its bottom hashes, as many as its partition allows to be missing, plus one:
  ``size - ceil(threshold * size) + 1`` at the partition's upper bound.
- A partition has its own index of sketch hashes, and a bound: its items' greatest
  sketch hash. A document's sketch for the partition is its shingle hashes up to that
  bound (a sketch by threshold, which unlike one of fixed length estimates containment
  however much longer the document is). It is looked up in the index.
- A document that contains an item has one of the item's sketch hashes, so the search
  loses nothing; candidates are verified by exact containment of the shingle strings.

Words are lower-cased and split at ASCII characters that are neither letters nor
digits. Items of fewer than k words have one shingle, all their words, looked for
in runs of that many words; items without words match nothing.

Items are the stated query set, dealt by a hash into blocks of about ``block_bytes`` of
text; the driver holds one block at a time, broadcasts its index and lets it go. Each
block searches all documents in one scan without a shuffle. Memory of a task: one text
and one block. Nulls (text) have no words; null item texts match nothing; repeated rows
and items give repeated results; other columns are ignored; an empty table of documents
or items gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, lean
from quillmesh.llm.shingles import plain_words, shingle_hashes, shingle_set


def sketch_size(n: int, threshold: float) -> int:
    """Bottom hashes that an item of n shingles needs: its size partition (the
    next power of two) may miss that many less one."""
    bound = 1 << (n - 1).bit_length() if n > 1 else n
    return min(n, bound - math.ceil(threshold * bound - 1e-9) + 1)


class Partition:
    """The index of one size partition: sketch hashes in order, whose they are, and the
    bound up to which documents are sketched."""

    def __init__(self, pairs: list[tuple[int, int]]):
        pairs.sort()
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.owner = np.array([i for _, i in pairs], np.int64)
        self.bound = self.hashes[-1]

    def candidates(self, own: np.ndarray) -> set[int]:
        """Items that share a sketch hash with a document of these ordered hashes."""
        sketch = own[: np.searchsorted(own, self.bound, "right")]
        if len(sketch) > len(self.hashes):
            at = np.searchsorted(sketch, self.hashes)
            return set(self.owner[sketch[np.minimum(at, len(sketch) - 1)] == self.hashes].tolist())
        first, last = np.searchsorted(self.hashes, sketch, "left"), np.searchsorted(self.hashes, sketch, "right")
        return {int(i) for h in np.flatnonzero(last > first).tolist() for i in self.owner[first[h] : last[h]]}


class Block:
    """Items of one search pass: an index per size partition, and the shingles."""

    def __init__(self, items, k: int, threshold: float):
        self.threshold = threshold
        self.shingles: list[tuple[int, set[bytes]]] = []
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            length = min(k, len(words))
            distinct = np.unique(shingle_hashes(words, length))
            of_size = pairs.setdefault((length, (len(distinct) - 1).bit_length()), [])
            of_size += [(h, len(self.shingles)) for h in distinct[: sketch_size(len(distinct), threshold)].tolist()]
            self.shingles.append((item_id, shingle_set(words, length)))
        #: By shingle length: the partitions by size.
        self.partitions: dict[int, list[Partition]] = {}
        for (length, _), found in sorted(pairs.items()):
            self.partitions.setdefault(length, []).append(Partition(found))

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item id, its shingles, of them in the text, share) of items contained."""
        words = plain_words(text)
        found = []
        for length, partitions in self.partitions.items():
            if len(words) < length:
                continue
            own = np.unique(shingle_hashes(words, length))
            candidates = set().union(*(p.candidates(own) for p in partitions))
            have = shingle_set(words, length) if candidates else ()
            for i in sorted(candidates):
                item_id, wanted = self.shingles[i]
                shared = len(wanted & have)
                if shared >= self.threshold * len(wanted) - 1e-9:
                    found.append((item_id, len(wanted), shared, shared / len(wanted)))
        return found


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = block.value.search
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in search(text.as_py())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = list(zip(*rows)) if rows else [()] * 5
            names = ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def item_blocks(items: DataFrame, item_id_col: str, item_text_col: str, block_bytes: int) -> Iterator[list]:
    """The items with words, (id, text), in blocks of about ``block_bytes`` of text; one
    block is fetched at a time."""
    wanted = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t IS NOT NULL")
    total = wanted.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = total // block_bytes + 1
    dealt = wanted.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for number in range(n):
        yield dealt.where(F.col("b") == number).select("i", "t").collect()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for every item
    contained in a document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double"
    found = None
    for rows in item_blocks(items, item_id_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Block(((r.i, r.t) for r in rows), k, threshold))
        one = source.mapInArrow(lean(_search(sent)), schema)
        found = one if found is None else found.union(one)
    return found


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options
) -> DataFrame:
    """The rows of ``docs`` whose id contains no item (rows with a null id stay)."""
    leaks = cut(contained_items(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_leak")).where("_leak IS NOT NULL").distinct())
    if leaks.count() <= broadcast_rows:  # 16 bytes a row
        leaks = F.broadcast(leaks)
    return docs.join(leaks, docs[id_col].cast("long") == F.col("_leak"), "left_anti")


#: The same rows in DuckDB SQL, from relations {docs} and {items}.
ORACLE = """
WITH pat AS (SELECT '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' AS p),
dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), (SELECT p FROM pat)) AS w FROM {docs}),
iw AS (SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(lower(text), (SELECT p FROM pat)) AS w FROM {items}),
il AS (SELECT *, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT iid, item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM il)),
z AS (SELECT iid, count(*) AS n FROM s GROUP BY iid),
ks AS (SELECT DISTINCT k FROM il),
d AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT dw.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k))
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n)::DOUBLE AS containment
FROM d JOIN s USING (k, s) JOIN z USING (iid) GROUP BY rid, doc_id, iid, item_id
HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""
