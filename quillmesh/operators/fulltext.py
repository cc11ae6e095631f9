"""BM25 full-text search over titles and bodies.

Contract: terms are lower-cased runs of letters and digits; query terms are OR-ed and
counted once; Okapi BM25 (k1 1.2, b 0.75, idf = ln(1 + (N - df + 0.5)/(df + 0.5)))
per field over all notes; a note's score is the better of its fields; the type
filter comes before the limit; order is score descending, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import tokens

K1, B = 1.2, 0.75
FIELDS = ("title", "body")


def _score(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _occurrences(terms: Column, wanted: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == wanted))


def postings(notes: DataFrame) -> DataFrame:
    """(field, term, id, tf, dl): the inverted index of both fields; write it
    partitioned or bucketed by term to serve many queries."""
    per_field = [notes.select("id", F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in FIELDS]
    both = per_field[0].union(per_field[1])
    each = both.select("id", "field", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(notes: DataFrame) -> DataFrame:
    """One row per field: notes and their mean length in terms."""
    lengths = notes.select(*(F.size(tokens(F.coalesce(F.col(f), F.lit("")))).alias(f) for f in FIELDS))
    row = lengths.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in FIELDS))
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("avgdl")) for f in FIELDS))).alias("s")).select("s.field", "n", "s.avgdl")


def rank_postings(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) from an inverted index: only the terms' postings are read."""
    mine = index.where(F.col("term").isin(terms))
    df = mine.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = mine.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")  # at most 2 x terms, and 2 rows
    value = _score(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("id", "field").agg(F.sum(value).alias("s")).groupBy("id").agg(F.max("s").alias("score"))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, as ``tokens`` makes them."""
    word, out = [], []
    for c in f"{query.lower()} ":
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return list(dict.fromkeys(out))


def rank(notes: DataFrame, query: str) -> DataFrame:
    """(id, score) of the notes that have a query term, from the texts themselves.

    One scan gives each field's length and its count of each query term (narrow
    rows: no term is exploded or shuffled); N, mean lengths and document
    frequencies are one aggregate row, which is joined back.
    """
    terms = query_terms(query)
    columns = [F.col("id")]
    for f in FIELDS:
        found = tokens(F.coalesce(F.col(f), F.lit("")))
        columns.append(
            F.element_at(
                F.transform(
                    F.array(found),
                    lambda t: F.struct(
                        F.size(t).alias("dl"), F.array(*(_occurrences(t, w) for w in terms)).alias("tf")
                    ),
                ),
                1,
            ).alias(f)
        )
    counted = notes.select(*columns)
    if not terms:
        return counted.where("false").select("id", F.lit(0.0).alias("score"))
    sums = [F.count(F.lit(1)).alias("n")]
    for f in FIELDS:
        sums.append(F.avg(F.col(f)["dl"]).alias(f"{f}_avg"))
        sums += [F.count_if(F.col(f)["tf"][i] > 0).alias(f"{f}_df{i}") for i in range(len(terms))]
    totals = counted.agg(*sums).withColumn("_one", F.lit(1))
    hits = counted.where(F.exists(F.concat(*(F.col(f)["tf"] for f in FIELDS)), lambda x: x > 0)).withColumn("_one", F.lit(1))
    joined = hits.join(F.broadcast(totals), "_one")  # one row
    scores = []
    for f in FIELDS:
        parts = [
            F.when(F.col(f)["tf"][i] > 0, _score(F.col("n"), F.col(f"{f}_df{i}"), F.col(f)["tf"][i], F.col(f)["dl"], F.col(f"{f}_avg"))).otherwise(0.0)
            for i in range(len(terms))
        ]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        scores.append(total)
    return joined.select("id", F.greatest(*scores).alias("score"))


def search(
    notes: DataFrame, query: str, type_: str | None = None, limit: int = 10, index: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """id, path, type, title, score of the best notes; ``index``: stored postings and
    field statistics of just these notes, so that the texts needn't be read."""
    if limit < 1:
        raise ValueError("limit must be positive")
    meta = notes.select("id", "path", "type", "title")
    if type_ is not None:
        meta = meta.where(F.col("type") == type_)
    scores = rank(notes, query) if index is None else rank_postings(*index, query_terms(query))
    ranked = scores.join(meta, "id")
    return ranked.select("id", "path", "type", "title", "score").orderBy(F.desc("score"), "id").limit(limit)
