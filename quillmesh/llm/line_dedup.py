"""Line de-duplication by site-relative frequency (DataFrame functions only).

For each host, the share of its pages that contain a line is the line's ratio;
lines over ``max_ratio`` (and on ``min_pages`` pages at least, so that a host with
few pages keeps its text) are boilerplate and are dropped from every page of that
host. A line is compared without ASCII white space at its ends; blank lines are
layout, never counted and never dropped.

Scale: lines are counted as two 64-bit hashes, summed on the map side, so a hot
host or line moves one row per task. A host has at most
(mean lines a page / max_ratio) boilerplate lines, whatever its size; that table
is cut to the checkpoint folder and broadcast only if its measured size is under
``broadcast_bytes``, else joined with the host's pages dealt over ``salts``.

With ``copies_once`` a page's line hashes move once per task and distinct text, not
its text; near copies, that differ in a line, still count as pages of their own.

Nulls: a null host is a host of its own; a null text stays null, has no lines and
counts as a page. Repeated rows are pages of their own. An empty table gives no
rows. Input columns named n_lines or n_dropped are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, deal_of

#: ASCII white space other than the line feed.
BLANKS = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def boilerplate_lines(
    docs: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int, copies_once: bool = False
) -> DataFrame:
    """(host, lines array<struct<a,b>>): the hashes of each host's boilerplate."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    if copies_once:
        return _boilerplate_of_texts(pages, max_ratio, min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "total_host")
    lines = (
        pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line"))
        .where("line <> ''")
        .select("host", _hashes(F.col("line")).alias("line"))
    )
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return _over_ratio(counted, totals, max_ratio, min_pages)


def _boilerplate_of_texts(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """``boilerplate_lines`` where a host's copies of a page are one page."""
    keys = F.filter(F.transform(F.split("text", "\n"), _key), lambda x: x != "")
    texts = pages.select("host", keys.alias("keys")).select(
        "host",
        _hashes(F.col("keys")).alias("page"),
        F.col("keys").isNull().alias("null_text"),
        F.array_distinct(F.transform("keys", _hashes)).alias("lines"),
    )
    texts = texts.dropDuplicates(["host", "page", "null_text"])
    totals = texts.groupBy(F.col("host").alias("total_host")).agg(F.count(F.lit(1)).alias("pages"))
    counted = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return _over_ratio(counted, totals, max_ratio, min_pages)


def _over_ratio(counted: DataFrame, totals: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    counted = counted.where(F.col("n") >= min_pages)
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("n") / F.col("pages") > max_ratio)
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 3,
    broadcast_bytes: int = 16 << 20,
    salts: int = 64,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, plus n_lines and
    n_dropped (long). ``copies_once``: a host's pages with the same lines (but for
    blank ones) count as one page, so a text is no boilerplate for being copied."""
    made = ("n_lines", "n_dropped", "_host", "_lines", "_salt")
    docs = docs.drop(*(c for c in docs.columns if c in made and c not in (host_col, text_col)))
    found = cut(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages, copies_once))
    found = found.select(F.col("host").alias("_host"), F.col("lines").alias("_lines"))
    size = found.agg(F.sum(F.size("_lines") * 40 + 100)).first()[0] or 0
    same = F.col(host_col).eqNullSafe(F.col("_host"))
    if size <= broadcast_bytes:
        joined = docs.join(F.broadcast(found), same, "left")
    else:
        spread = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = docs.withColumn("_deal", deal_of(docs, salts))
        joined = dealt.join(spread, same & (F.col("_deal") == F.col("_salt")), "left").drop("_deal")
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x: (_key(x) == "") | ~F.array_contains(F.col("_lines"), _hashes(_key(x))))
    clean = F.when(F.col("_lines").isNull(), lines).otherwise(kept)
    return (
        joined.withColumn("_kept", clean)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines")))
        .withColumn("n_dropped", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
        .withColumn(text_col, F.array_join("_kept", "\n"))
        .drop("_kept", *made[2:])
    )


#: The same rows in DuckDB SQL, from a relation {docs} with doc_id, source, text.
ORACLE = """
WITH d AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
n AS (SELECT source, key, count(DISTINCT rid) AS n FROM k WHERE key <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY ALL),
b AS (SELECT n.source, n.key FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n / pages > 0.1),
m AS (SELECT k.*, b.key IS NOT NULL AS bad FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key),
a AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text,
      count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped FROM m GROUP BY rid)
SELECT d.* EXCLUDE (rid, text), CASE WHEN d.text IS NULL THEN NULL ELSE a.text END AS text,
       coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN a USING (rid)
"""
