"""Language identification by nearest centroid.

A text's vector: counts of hashed letter n-grams (1 to 3, lower-cased, words
separated by one blank), as log(1 + count) times IDF, normalised. Each language
has up to ``clusters`` centroids, found by spherical k-means over its training
texts; the prediction is the language of the centroid of the highest cosine. A
text is rejected if it has no letter or if its cosine is under a share (``slack``)
of the lowest that a training text of that language had: too far from anything
learned.

Fitting reads a bounded sample: at most ``max_train`` rows over all languages, each
language an equal share, picked by a hash of the id, whole texts. The model
(languages x clusters x 16,384 floats) is shipped with the tasks; prediction is
one scan, one text at a time, without a shuffle.

Nulls: rows with null text, language or id are not learned from; a null text is
predicted und with score 0. With nothing to learn from, everything is und.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import lean

BINS = 1 << 14


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bins and counts of a text's n-grams (none: it has no letter)."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    wide = codes > 0xFFFF
    letter = _letters()[np.where(wide, 0, codes).astype(np.int64)]
    if wide.any():
        letter[wide] = [chr(int(c)).isalpha() for c in codes[wide]]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter, codes, np.uint64(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    one = np.concatenate(([np.uint64(32)], codes[keep], [np.uint64(32)]))
    two = one[:-1] * np.uint64(0x10001) + one[1:] + np.uint64(1 << 40)
    three = two[:-1] * np.uint64(0x10001) + one[2:] + np.uint64(1 << 41)
    hashed = np.concatenate((one[1:-1], two, three)) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((hashed >> np.uint64(50)).astype(np.int64), minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


@dataclass
class CentroidModel:
    """Centroids (rows, normalised), their languages, IDF and rejection bounds."""

    languages: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(BINS, np.float32))
    bounds: dict[str, float] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        bins, counts = ngram_counts(text)
        if not len(bins) or not self.languages:
            return "und", 0.0, True
        weights = np.log1p(counts) * self.idf[bins]
        weights /= max(np.linalg.norm(weights), 1e-12)
        cosines = self.centroids[:, bins] @ weights
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < self.bounds[self.languages[best]]


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: up to k normalised centroids."""
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) for c in range(len(centres)) if (nearest == c).any()])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train: int = 2400,
    clusters: int = 4,
    slack: float = 0.5,
) -> CentroidModel:
    """Learn from the rows of ``docs`` (already limited to training rows)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return CentroidModel()
    share = max(1, max_train // len(totals))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    fraction = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, share / n))) for k, n in sorted(totals.items())))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py()) for t in batch.column(1)]
            pack = [pa.array([x[i].astype("<u4").tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *pack], ["lang", "bins", "counts"])

    sample = rows.where(place < fraction).select("lang", "text").mapInArrow(lean(features), "lang string, bins binary, counts binary")
    kept = [(r.lang, np.frombuffer(r.bins, "<u4"), np.frombuffer(r.counts, "<u4")) for r in sample.collect() if r.bins]
    kept.sort(key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))
    if not kept:
        return CentroidModel()
    df = np.zeros(BINS)
    for _, bins, _ in kept:
        df[bins] += 1
    model = CentroidModel(idf=(np.log((1 + len(kept)) / (1 + df)) + 1).astype(np.float32))
    rng, all_centres = np.random.default_rng(4), []
    for lang in sorted({x[0] for x in kept}):
        mine = [(b, c) for of, b, c in kept if of == lang]
        vectors = np.zeros((len(mine), BINS), np.float32)
        for row, (bins, counts) in enumerate(mine):
            vectors[row, bins] = np.log1p(counts) * model.idf[bins]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        centres = _kmeans(vectors, clusters, rng)
        all_centres.append(centres)
        model.languages += [lang] * len(centres)
        model.bounds[lang] = slack * float((vectors @ centres.T).max(axis=1).min())
    model.centroids = np.concatenate(all_centres).astype(np.float32)
    return model


def predict(docs: DataFrame, model: CentroidModel, id_col: Column | str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row; ``id_col`` passes through."""
    source = docs.select(F.col(id_col).alias("id") if isinstance(id_col, str) else id_col.alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            made = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "lang_pred", "score", "rejected"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"id {kind}, lang_pred string, score double, rejected boolean")
