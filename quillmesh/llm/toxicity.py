"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag has a label. A sentence's
score is logistic in its words and word beginnings; the document's score is their
noisy-or, 1 - prod(1 - sentence score), and the weights are trained from document
labels through it, so that high-scoring sentences show where the offence is.

Fitting reads a bounded sample: at most ``max_train`` labelled ids, half of each
class as far as there are so many, picked by a hash of the id, whole texts;
the classes are weighted back to their shares. At most ``max_features`` features (65,536 and
no more) are kept, by their chi-squared statistic in the sample, which Spark counts; the
driver gets their names and, per text, where they occur (6 bytes each). Scoring is one scan
without a shuffle, one text at a time.

Nulls: rows with a null id, text or label are not learned from; a null text or one
without words has no sentence and scores 0. An id with several labels is toxic if one
says so; ids with several texts are learned from by all, or a share of the rows where
they are more than ``max_train``. Ties of chi-squared go to the smaller feature. With
nothing to learn from all scores are 0. Repeated rows give repeated results, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut

_TOKENS = re.compile(r"\w+|[.!?…。！？\n]").findall
_ENDS = frozenset(".!?…。！？\n")


@lru_cache(maxsize=200_000)
def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    names = ["=" + word, *(f"^{word[:n]}" for n in (3, 4, 5, 6, 7) if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in names)


@dataclass
class ToxicModel:
    """Weights by feature, and the bias of a sentence."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _WordWeights(dict):
    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = float("nan") if word in _ENDS else sum(self.weights.get(f, 0.0) for f in word_features(word))
        self[word] = value
        return value


class _Scorer:
    def __init__(self, model: ToxicModel, max_words: int = 400_000):
        self.words, self.bias, self.max_words = _WordWeights(model.weights), model.bias, max_words

    def sentences(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens, each token's sentence, and each sentence's logit (NaN: no word)."""
        tokens = _TOKENS((text or "").lower())
        if len(self.words) > self.max_words:
            self.words.clear()
        values = np.fromiter(map(self.words.__getitem__, tokens), np.float64, len(tokens))
        ends = np.isnan(values)
        of = np.cumsum(ends) - ends
        n = int(of[-1]) + 1 if len(of) else 0
        filled = np.bincount(of[~ends], minlength=n) > 0
        logits = np.bincount(of, np.where(ends, 0.0, values), minlength=n) + self.bias
        return tokens, of, np.where(filled, logits, np.nan)

    def score(self, text: str | None) -> float:
        logits = self.sentences(text)[2]
        logits = logits[~np.isnan(logits)]
        return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0

    def offending(self, text: str | None, threshold: float = 0.3) -> list[tuple[int, float, str]]:
        """(number, score, text) of the sentences at or over ``threshold``."""
        parts = re.split(r"(?<=[.!?…。！？\n])", text or "")
        found = []
        for number, part in enumerate(parts):
            value = self.score(part)
            if part.strip() and value >= threshold:
                found.append((number, value, part.strip()))
        return found


def _train(bags: list[tuple[int, int, np.ndarray, np.ndarray]], names: np.ndarray, shares: dict[int, float], rounds: int) -> ToxicModel:
    """bags: (label, sentences, feature numbers, sentence of each feature)."""
    labels = np.array([y for y, _, _, _ in bags], float)
    weight = np.where(labels == 1, shares[1], shares[0])
    base = np.cumsum([0] + [n for _, n, _, _ in bags])
    column = np.concatenate([f for _, _, f, _ in bags]).astype(np.int64)
    row = np.concatenate([s + first for (_, _, _, s), first in zip(bags, base)])
    n_sentences = int(base[-1])
    sentence_doc = np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(base))
    w, bias = np.zeros(len(names)), -6.0
    grad_w, grad_b = np.full(len(names), 1e-6), 1e-6
    total = weight.sum()
    for _ in range(rounds):
        g, _ = noisy_or_gradient(np.bincount(row, w[column], minlength=n_sentences) + bias, sentence_doc, labels, weight)
        gw = np.bincount(column, g[row], minlength=len(names)) / total + 1e-6 * w
        gb = g.sum() / total
        grad_w += gw * gw
        grad_b += gb * gb
        w -= 0.5 * gw / np.sqrt(grad_w)
        bias -= 0.2 * gb / np.sqrt(grad_b)
    return ToxicModel({int(c): float(v) for c, v in zip(names, w) if abs(v) > 1e-3}, float(bias))


def noisy_or_gradient(z: np.ndarray, doc: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the weighted log loss by each sentence's logit, and the loss."""
    clean = np.bincount(doc, np.logaddexp(0, z), minlength=len(labels))  # -log(1 - P)
    toxic = np.maximum(-np.expm1(-clean), 1e-9)
    share = np.where(labels == 1, -np.exp(-clean) / toxic, 1.0) * weight
    return share[doc] / (1 + np.exp(-z)), float((weight * np.where(labels == 1, -np.log(toxic), clean)).sum())


def _bag(text: str) -> tuple[list[int], list[int], int]:
    """A text's features, the sentence of each, and its number of sentences with a word."""
    codes, of, n, filled = [], [], 0, False
    for token in _TOKENS(text.lower()):
        if token in _ENDS:
            n, filled = n + filled, False
        else:
            found = word_features(token)
            codes += found
            of += [n] * len(found)
            filled = True
    return codes, of, n + filled


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.unique(np.array(_bag(value.as_py())[0], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), y, np.int32)), pa.array(own)], ["y", "f"])


def _chosen_features(names: np.ndarray):
    """Rows (y, text) -> the bag with the features of ``names`` only, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sentences, sizes = [], [], []
            for value in batch.column(1):
                codes, of, n = _bag(value.as_py())
                codes = np.array(codes, np.int64)
                at = np.minimum(np.searchsorted(names, codes), len(names) - 1)
                use = names[at] == codes
                numbers.append(at[use].astype("<u2").tobytes())
                sentences.append(np.array(of, "<u4")[use].tobytes())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(sentences, pa.binary())], ["y", "n", "f", "s"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    max_train: int = 5000,
    max_features: int = 1000,
    rounds: int = 250,
) -> ToxicModel:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1 (both already
    limited to training rows)."""
    marks = labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("y").alias("y"))
    totals = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(totals) < 2:
        return ToxicModel()
    half = max_train // 2
    # at most half of each label, those of the least hashes (a limit, so a bound)
    place = F.xxhash64(F.col("_id").cast("string"), F.lit(6))
    picked = [marks.where(F.col("y") == y).orderBy(place, "_id").limit(half) for y in (0, 1)]
    chosen = cut(picked[0].union(picked[1]))
    texts = docs.select(F.col(id_col).alias("_did"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), F.col("_did") == F.col("_id"))  # chosen: at most max_train rows
    rows = sample.groupBy("_id").count().agg(F.sum("count")).first()[0] or 0
    if rows > max_train:  # ids with many rows: a share of the rows
        sample = sample.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int((1 << 30) * max_train / rows))
    sample = cut(sample.select("y", "text").limit(2 * max_train))
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ToxicModel()
    # features by chi-squared, in Spark: only their names come to the driver
    share = sizes[1] / (sizes[0] + sizes[1])
    expected = F.col("df") * share
    off = (F.col("pos") - expected) * (F.col("pos") - expected)
    counted = sample.mapInArrow(_distinct_features, "y int, f bigint").groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos")).where("df >= 3")
    best = counted.select("f", (off / expected + off / (F.col("df") - expected)).alias("chi")).orderBy(F.desc("chi"), "f").limit(max_features)
    names = np.array(sorted(r.f for r in best.collect()), np.int64)
    if not len(names):
        return ToxicModel()
    made = sample.mapInArrow(_chosen_features(names), "y int, n bigint, f binary, s binary").where("n > 0").collect()
    bags = sorted(((r.y, r.n, bytes(r.f), bytes(r.s)) for r in made), key=lambda x: (x[0], xxhash.xxh64_digest(x[2] + x[3]), x[1]))
    del made
    bags = [(y, n, np.frombuffer(f, "<u2"), np.frombuffer(s, "<u4").astype(np.int64)) for y, n, f, s in bags]
    have = {y: sum(b[0] == y for b in bags) for y in (0, 1)}
    if not have[0] or not have[1]:
        return ToxicModel()
    return _train(bags, names, {y: totals[y] / have[y] for y in (0, 1)}, rounds)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, with_sentences: bool = True) -> DataFrame:
    """(doc_id, score, predicted[, sentences]) of every row; sentences: the
    offending ones as array<struct<number, score, text>>, for predicted rows."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("number", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            texts = batch.column(1)
            values = [scorer.score(t.as_py()) for t in texts]
            made = [pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32())]
            names = ["doc_id", "score", "predicted"]
            if with_sentences:
                where = [scorer.offending(t.as_py(), threshold) if v >= threshold else [] for t, v in zip(texts, values)]
                made.append(pa.array([[{"number": a, "score": b, "text": c} for a, b, c in x] for x in where], kind))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    extra = ", sentences array<struct<number: int, score: double, text: string>>" if with_sentences else ""
    return source.mapInArrow(run, f"doc_id bigint, score double, predicted int{extra}")
