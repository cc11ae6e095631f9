"""The engine's operators over the driver's tables, each with its DuckDB SQL.

The tables hold no markdown, so parser inputs are built from their columns by the
same expression on both sides. Notes are documents; the graph is the star schema:
nodes region, nation, customer, supplier, orders, part and their foreign keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.embedders import HashEmbedder
from quillmesh.operators import fulltext, hybrid, vector
from quillmesh.operators import notes as ops
from quillmesh.operators.chunks import chunk_notes, embed_notes
from quillmesh.plans.cypher import PropertyGraph
from quillmesh.sources.vault_files import parse_contents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# ---- notes from documents --------------------------------------------------

_NOTES_SQL = """notes AS (SELECT source || '/doc-' || doc_id AS id, source || '/doc-' || doc_id || '.md' AS path, lang AS type,
 'Document ' || doc_id AS title, text AS body, md5(text) AS content_hash, doc_id FROM documents)"""


def notes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    at = F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"))
    return d.select(
        at.alias("id"),
        F.concat(at, F.lit(".md")).alias("path"),
        F.col("lang").alias("type"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.to_json(F.struct("n_chars")).alias("frontmatter_json"),
        F.col("text").alias("body"),
        F.md5(F.col("text").cast("binary")).alias("content_hash"),
        "doc_id",
    )


@_query("SELECT lang AS type, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def types_count(spark, sf_dir):
    return ops.type_counts(notes_table(spark, sf_dir))


@_query(f"WITH {_NOTES_SQL} SELECT id, path, type, title, body FROM notes WHERE id = 'src7/doc-7' OR id IN (SELECT min(id) FROM notes)")
def get_note(spark, sf_dir):
    notes = notes_table(spark, sf_dir)
    least = notes.agg(F.min("id")).first()[0]
    found = ops.get_note(notes, f"{least}.md", body=True)
    return found.union(ops.get_note(notes, "src7/doc-7", body=True)).drop("frontmatter").distinct()


_CONTENT = "'---' || chr(10) || 'type: ' || lang || chr(10) || 'from: \"[[' || source || ']]\"' || chr(10) || '---' || chr(10) || '# Document ' || doc_id || chr(10) || text"


def _content() -> Column:
    return F.concat(
        F.lit("---\ntype: "), F.col("lang"), F.lit('\nfrom: "[['), F.col("source"), F.lit(']]"\n---\n# Document '), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")
    )


@_query(
    "SELECT doc_id, 'type: ' || lang || chr(10) || 'from: \"[[' || source || ']]\"' AS raw, '# Document ' || doc_id || chr(10) || text AS body FROM documents"
)
def frontmatter_split(spark, sf_dir):
    c = _content()
    return _table(spark, sf_dir, "documents").select("doc_id", T.frontmatter_raw(c).alias("raw"), T.body_of(c).alias("body"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Document ' || doc_id ELSE 'doc.' || doc_id END AS title FROM documents")
def note_title(spark, sf_dir):
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## no\n#  Document "), F.col("doc_id").cast("string"))).otherwise(F.lit("#\nno heading"))
    path = F.concat(F.lit("a/doc."), F.col("doc_id").cast("string"), F.lit(".md"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.concat(heading, F.lit("\n"), F.regexp_replace("text", "(?m)^# ", "")), path).alias("title"))


@_query(
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN source || '/' || doc_id || '.MD' ELSE source || '/' || doc_id || '.md' END AS id, "
    "CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || '.MD' ELSE doc_id || '.md' END AS base FROM documents"
)
def note_ids(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".MD").otherwise(".md.md")
    rel = F.concat(F.col("source"), F.lit("\\"), F.col("doc_id").cast("string"), ending)
    return _table(spark, sf_dir, "documents").select("doc_id", T.note_id(rel).alias("id"), T.basename(T.note_id(rel)).alias("base"))


@_query(
    """WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'see [[' || source || ']]' WHEN 1 THEN '[[' || source || '| The ' || doc_id || ' ]] and [[x#top]]'
 WHEN 2 THEN '[[ ]] [[' || source || '#part|Alias]] [[y^b1]]' ELSE 'none [a](b)' END AS line FROM documents),
 m AS (SELECT doc_id, unnest(regexp_extract_all(line, '\\[\\[([^\\]|#^]+)(?:[#^][^\\]|]*)?(?:\\|([^\\]]+))?\\]\\]', 1)) AS t,
  unnest(regexp_extract_all(line, '\\[\\[([^\\]|#^]+)(?:[#^][^\\]|]*)?(?:\\|([^\\]]+))?\\]\\]', 2)) AS a FROM s)
 SELECT doc_id, trim(t) AS target, nullif(trim(coalesce(a, '')), '') AS alias FROM m WHERE trim(t) <> ''"""
)
def wikilink_extract(spark, sf_dir):
    n, src = F.col("doc_id"), F.col("source")
    line = (
        F.when(n % 4 == 0, F.concat(F.lit("see [["), src, F.lit("]]")))
        .when(n % 4 == 1, F.concat(F.lit("[["), src, F.lit("| The "), n.cast("string"), F.lit(" ]] and [[x#top]]")))
        .when(n % 4 == 2, F.concat(F.lit("[[ ]] [["), src, F.lit("#part|Alias]] [[y^b1]]")))
        .otherwise("none [a](b)")
    )
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.wikilinks(line)).alias("l")).select("doc_id", "l.target", "l.alias")


@_query(
    "SELECT 'd' || doc_id AS from_id, 'from' AS edge_type, source AS to_raw, NULL::VARCHAR AS to_alias, 0::INTEGER AS position FROM documents"
)
def edge_explode(spark, sf_dir):
    rel = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    contents = _table(spark, sf_dir, "documents").select(rel.alias("rel"), _content().alias("content"))
    return ops.explode_links(parse_contents(contents))


@_query("SELECT 'd' || doc_id AS id, lang AS type, 'Document ' || doc_id AS title, 'd' || doc_id || '.md' AS path, '# Document ' || doc_id || chr(10) || text AS body FROM documents")
def parse_notes(spark, sf_dir):
    rel = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    contents = _table(spark, sf_dir, "documents").select(rel.alias("rel"), _content().alias("content"))
    return parse_contents(contents).select("id", "type", "title", "path", "body")


_RAW_SQL = """live AS (SELECT 'customer/' || c_custkey AS id FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier),
raw AS (SELECT 'orders/' || o_orderkey AS from_id, 'placed_by' AS edge_type,
 CASE o_orderkey % 4 WHEN 0 THEN ' customer/' || o_custkey WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN 'wrong\\' || o_custkey || '.md' ELSE 'gone/x' || o_orderkey END AS to_raw FROM orders),
norm AS (SELECT *, replace(regexp_replace(trim(to_raw), '\\.md$', ''), '\\', '/') AS t FROM raw),
uniq AS (SELECT regexp_extract(id, '[^/]*$') AS base, min(id) AS only_id FROM live GROUP BY ALL HAVING count(*) = 1),
edges AS (SELECT from_id, edge_type, coalesce(l.id, u.only_id, t) AS to_id, to_raw, NULL::VARCHAR AS to_alias,
 l.id IS NOT NULL OR u.only_id IS NOT NULL AS resolved, 0::INTEGER AS position
 FROM norm LEFT JOIN live l ON t = l.id LEFT JOIN uniq u ON regexp_extract(t, '[^/]*$') = u.base)"""


def _resolved(spark, sf_dir) -> DataFrame:
    live = (
        _table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("id"))
        .union(_table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))))
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    to_raw = (
        F.when(key % 4 == 0, F.concat(F.lit(" customer/"), cust)).when(key % 4 == 1, cust)
        .when(key % 4 == 2, F.concat(F.lit("wrong\\"), cust, F.lit(".md"))).otherwise(F.concat(F.lit("gone/x"), key.cast("string")))
    )
    raw = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders/"), key.cast("string")).alias("from_id"), F.lit("placed_by").alias("edge_type"), to_raw.alias("to_raw"),
        F.lit(None).cast("string").alias("to_alias"), F.lit(0).alias("position"),
    )
    return ops.resolve_links(raw, live)


@_query(f"WITH {_RAW_SQL} SELECT * FROM edges")
def link_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@_query(f"WITH {_RAW_SQL} SELECT count(*) AS edges, count(*) FILTER (NOT resolved) AS unresolved FROM edges")
def edge_totals(spark, sf_dir):
    return ops.edge_totals(_resolved(spark, sf_dir))


# ---- full text -------------------------------------------------------------


def _bm25_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{_NOTES_SQL},
tok AS (SELECT id, 'title' AS field, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM notes
 UNION ALL SELECT id, 'body', list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM notes),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS avgdl FROM tok GROUP BY field),
p AS (SELECT id, field, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, field, len(w) AS dl, unnest(w) AS term FROM tok) WHERE term IN ({listed}) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
fs AS (SELECT id, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
 FROM p JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
bm AS (SELECT id, max(s) AS score FROM fs GROUP BY id)"""


def _bm25_top(terms: list[str], where: str = "true", limit: int = 10) -> str:
    return f"WITH {_bm25_sql(terms)} SELECT id, path, type, title, round(score, 6) AS score FROM bm JOIN notes USING (id) WHERE {where} ORDER BY bm.score DESC, id LIMIT {limit}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


@_query(_bm25_top(["license", "onering"]))
def bm25_search(spark, sf_dir):
    return _rounded(fulltext.search(notes_table(spark, sf_dir), "License onering license"), "score")


@_query(_bm25_top(["the", "tion", "mentai", "document"], "type = 'en'", 25))
def bm25_search_typed(spark, sf_dir):
    return _rounded(fulltext.search(notes_table(spark, sf_dir), "the tion Mentai document", "en", 25), "score")


@_query(f"WITH {_bm25_sql(['license', 'onering'])} SELECT id, round(score, 6) AS score FROM bm")
def bm25_postings(spark, sf_dir):
    notes = notes_table(spark, sf_dir)
    return _rounded(fulltext.rank_postings(fulltext.postings(notes), fulltext.corpus_stats(notes), ["license", "onering"]), "score")


@_query(
    """WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
 SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term"""
)
def term_statistics(spark, sf_dir):
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    per_doc = each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


# ---- vectors ---------------------------------------------------------------


def _chunks(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    note = F.concat(F.lit("n"), F.floor(F.col("vec_id") / 5).cast("string"))
    return e.select(
        note.alias("note_id"), (F.col("vec_id") % 5).cast("int").alias("seq"), F.concat(F.lit(" chunk "), F.col("vec_id").cast("string"), F.lit("\n")).alias("chunk_text"),
        F.col("embedding").alias("vector"), "vec_id", "label",
    )


def _probe(spark, sf_dir) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0])


_KNN_SQL = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
hit AS (SELECT 'n' || (vec_id // 5) AS note_id, (vec_id % 5)::INTEGER AS seq, 'chunk ' || vec_id AS snippet, label,
 list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM embeddings, q)"""


@_query(f"WITH {_KNN_SQL} SELECT note_id, seq, round(sim, 6) AS similarity FROM hit ORDER BY sim DESC, note_id, seq LIMIT 20")
def knn_cosine(spark, sf_dir):
    found = vector.nearest(_chunks(spark, sf_dir), _probe(spark, sf_dir), 20)
    return _rounded(found.select("note_id", "seq", "similarity"), "similarity")


@_query(f"WITH {_KNN_SQL} SELECT note_id, seq, round(sim, 6) AS similarity FROM hit")
def vector_similarity(spark, sf_dir):
    found = vector.similarity(_chunks(spark, sf_dir).select("note_id", "seq", "vector"), _probe(spark, sf_dir))
    return _rounded(found, "similarity")


_SIMILAR_SQL = """top AS (SELECT * FROM hit ORDER BY sim DESC, note_id, seq LIMIT 80),
best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY sim DESC, seq) = 1)"""


def _vector_notes(spark, sf_dir) -> DataFrame:
    return _chunks(spark, sf_dir).where("seq = 0").select(F.col("note_id").alias("id"), F.concat("note_id", F.lit(".md")).alias("path"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("type"), F.upper("note_id").alias("title"))


def _similar_sql(where: str) -> str:
    return f"""WITH {_KNN_SQL}, {_SIMILAR_SQL}, n AS (SELECT 'n' || (vec_id // 5) AS note_id, 't' || label AS type FROM embeddings WHERE vec_id % 5 = 0)
 SELECT note_id AS id, note_id || '.md' AS path, n.type, upper(note_id) AS title, round(sim, 6) AS score, seq AS chunk_seq, snippet
 FROM best JOIN n USING (note_id) WHERE {where} ORDER BY sim DESC, id LIMIT 10"""


@_query(_similar_sql("true"))
def similar_best_chunk(spark, sf_dir):
    return _rounded(vector.similar(_vector_notes(spark, sf_dir), _chunks(spark, sf_dir), _probe(spark, sf_dir)), "score")


@_query(_similar_sql("n.type = 't3'"))
def similar_typed(spark, sf_dir):
    return _rounded(vector.similar(_vector_notes(spark, sf_dir), _chunks(spark, sf_dir), _probe(spark, sf_dir), "t3"), "score")


@_query(
    f"""WITH {_bm25_sql(["license", "onering"])},
 q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
 lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50)),
 hit AS (SELECT id, 'chunk ' || vec_id AS snippet, list_cosine_similarity(embedding::DOUBLE[], q) AS sim FROM embeddings, q, notes WHERE vec_id = doc_id ORDER BY sim DESC, id LIMIT 50),
 vec AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS r FROM hit),
 f AS (SELECT id, coalesce(1.0::DOUBLE / (60 + lex.r), 0) + coalesce(1.0::DOUBLE / (60 + vec.r), 0) AS score, lex.score AS b, sim, snippet FROM lex FULL JOIN vec USING (id))
 SELECT id, path, type, title, round(f.score, 6) AS score, round(b, 6) AS bm25_score, round(sim, 6) AS similarity, snippet
 FROM f JOIN notes USING (id) ORDER BY f.score DESC, id LIMIT 10"""
)
def hybrid_rrf(spark, sf_dir):
    notes = notes_table(spark, sf_dir)
    ids = notes.select(F.col("doc_id").alias("vec_id"), F.col("id").alias("note_id"))
    chunks = _chunks(spark, sf_dir).drop("note_id").join(ids, "vec_id").withColumn("seq", F.lit(0))
    return _rounded(hybrid.hybrid(notes, chunks, "license onering", _probe(spark, sf_dir)), "score", "bm25_score", "similarity")


@_query(
    """WITH a AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 50),
 b AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 50)
 SELECT k AS id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k"""
)
def rank_fusion(spark, sf_dir):
    a = _table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    b = _table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    lists = (hybrid.ranked(a, "o_totalprice", "o_orderkey").select(F.col("o_custkey").alias("id"), "rank"), hybrid.ranked(b, "c_acctbal", "c_custkey").select(F.col("c_custkey").alias("id"), "rank"))
    return _rounded(hybrid.fuse(*lists), "score")


# ---- incremental maintenance -----------------------------------------------

_STATE_SQL = """prior AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS content_hash, n_chars AS size_bytes FROM documents WHERE doc_id % 10 <> 0),
now AS (SELECT doc_id AS id, md5(text) AS content_hash, n_chars AS size_bytes FROM documents WHERE doc_id % 11 <> 0)"""


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents")
    h = F.md5(F.col("text").cast("binary"))
    prior = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(h).alias("content_hash"), F.col("n_chars").alias("size_bytes"))
    now = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), h.alias("content_hash"), F.col("n_chars").alias("size_bytes"))
    return prior, now


_DIFF_SQL = """SELECT coalesce(n.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
 WHEN p.content_hash IS NOT DISTINCT FROM n.content_hash AND p.size_bytes IS NOT DISTINCT FROM n.size_bytes THEN 'same' ELSE 'changed' END AS status
 FROM prior p FULL JOIN now n ON p.id = n.id"""


@_query(f"WITH {_STATE_SQL} {_DIFF_SQL}")
def index_diff(spark, sf_dir):
    return ops.diff_state(*_states(spark, sf_dir), "id", "content_hash", "size_bytes")


@_query(f"WITH {_STATE_SQL}, d AS ({_DIFF_SQL}) SELECT status, count(*) AS count FROM d GROUP BY status")
def index_stats(spark, sf_dir):
    return ops.diff_state(*_states(spark, sf_dir), "id", "content_hash", "size_bytes").groupBy("status").count()


@_query(f"WITH {_STATE_SQL} SELECT * FROM prior WHERE id NOT IN (SELECT id FROM now) UNION ALL SELECT * FROM now")
def notes_upsert(spark, sf_dir):
    return ops.upsert(*_states(spark, sf_dir), "id")


@_query(f"WITH {_STATE_SQL} SELECT * FROM prior WHERE id NOT IN (SELECT id FROM now)")
def notes_delete(spark, sf_dir):
    return ops.delete_keys(*_states(spark, sf_dir), "id")


@_query(
    """WITH e AS (SELECT l_orderkey AS from_id, l_partkey AS to_id, l_linenumber AS position FROM lineitem)
 SELECT * FROM e WHERE from_id % 5 <> 0 UNION ALL SELECT from_id, to_id + 1, position FROM e WHERE from_id % 10 = 0"""
)
def edges_replace(spark, sf_dir):
    e = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linenumber").alias("position"))
    owners = _table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("from_id"))
    fresh = e.where("from_id % 10 = 0").withColumn("to_id", F.col("to_id") + 1)
    return ops.replace_owned(e, owners, fresh, "from_id")


@_query(
    """WITH s AS (SELECT DISTINCT vec_id // 5 AS id, md5(label::VARCHAR) AS content_hash FROM embeddings WHERE vec_id % 5 = 0),
 n AS (SELECT doc_id AS id, md5((doc_id % 10)::VARCHAR) AS content_hash FROM documents)
 SELECT coalesce(n.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN s.content_hash = n.content_hash THEN 'same' ELSE 'changed' END AS status
 FROM s FULL JOIN n ON s.id = n.id"""
)
def embed_diff(spark, sf_dir):
    label = F.md5(F.col("label").cast("string").cast("binary"))
    state = _table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select(F.floor(F.col("vec_id") / 5).alias("id"), label.alias("content_hash")).distinct()
    now = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5((F.col("doc_id") % 10).cast("string").cast("binary")).alias("content_hash"))
    return ops.diff_state(state, now, "id", "content_hash")


@_query()
def chunk_markdown(spark, sf_dir):
    return chunk_notes(notes_table(spark, sf_dir)).select("note_id", "seq", "chunk_text")


@_query()
def hash_embed(spark, sf_dir):
    found = embed_notes(notes_table(spark, sf_dir), HashEmbedder(), 0)
    return found.select("note_id", "seq", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


# ---- graph -----------------------------------------------------------------

_NODE_TABLES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name"), "orders": ("o_orderkey", "o_orderstatus"), "part": ("p_partkey", "p_name"),
}
_EDGE_TABLES = (
    ("nation", "in_region", "nation", "n_nationkey", "region", "n_regionkey"),
    ("customer", "in_nation", "customer", "c_custkey", "nation", "c_nationkey"),
    ("supplier", "in_nation", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("orders", "placed_by", "orders", "o_orderkey", "customer", "o_custkey"),
    ("lineitem", "contains", "orders", "l_orderkey", "part", "l_partkey"),
    ("lineitem", "supplied_by", "part", "l_partkey", "supplier", "l_suppkey"),
)


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star schema as nodes (id, path, type, title) and edges."""
    nodes = edges = None
    for table, (key, name) in _NODE_TABLES.items():
        at = F.concat(F.lit(f"{table}/"), F.col(key).cast("string"))
        one = _table(spark, sf_dir, table).select(at.alias("id"), F.concat(at, F.lit(".md")).alias("path"), F.lit(table).alias("type"), F.col(name).alias("title"))
        nodes = one if nodes is None else nodes.union(one)
    for table, kind, from_label, from_key, to_label, to_key in _EDGE_TABLES:
        to = F.concat(F.lit(f"{to_label}/"), F.col(to_key).cast("string"))
        one = _table(spark, sf_dir, table).select(
            F.concat(F.lit(f"{from_label}/"), F.col(from_key).cast("string")).alias("from_id"), F.lit(kind).alias("edge_type"), to.alias("to_id"), to.alias("to_raw"),
            F.lit(None).cast("string").alias("to_alias"), F.lit(True).alias("resolved"), (F.col("l_linenumber") if kind == "contains" else F.lit(0)).alias("position"),
        )
        edges = one if edges is None else edges.union(one)
    return PropertyGraph(nodes, edges)


_GRAPH_SQL = (
    "nodes AS ("
    + " UNION ALL ".join(f"SELECT '{t}/' || {k} AS id, '{t}/' || {k} || '.md' AS path, '{t}' AS type, {n} AS title FROM {t}" for t, (k, n) in _NODE_TABLES.items())
    + "), edges AS ("
    + " UNION ALL ".join(
        f"SELECT '{fl}/' || {fk} AS from_id, '{e}' AS edge_type, '{tl}/' || {tk} AS to_id, {'l_linenumber' if e == 'contains' else '0::INTEGER'} AS position FROM {t}"
        for t, e, fl, fk, tl, tk in _EDGE_TABLES
    )
    + ")"
)


def _cypher(name: str, text: str, sql: str, params: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return star_graph(spark, sf_dir).query(text, params)

    _query(f"WITH {_GRAPH_SQL} {sql}", name)(run)


def _hop(*steps: str) -> str:
    """FROM clause of a chain n0 -e0-> n1 -e1-> n2 ... over edge types."""
    out = "nodes n0"
    for i, s in enumerate(steps):
        kind = f" AND e{i}.edge_type = '{s}'" if s else ""
        out += f" JOIN edges e{i} ON e{i}.from_id = n{i}.id{kind} JOIN nodes n{i + 1} ON n{i + 1}.id = e{i}.to_id"
    return out


_cypher("cypher_label", "MATCH (n:Nation) RETURN n.id, n.title", "SELECT id AS \"n.id\", title AS \"n.title\" FROM nodes WHERE type = 'nation'")
_cypher("cypher_one_hop", "MATCH (a:customer)-[:in_nation]->(b:nation) RETURN a.id, b.title", f"SELECT n0.id AS \"a.id\", n1.title AS \"b.title\" FROM {_hop('in_nation')} WHERE n0.type = 'customer'")
_cypher(
    "cypher_two_hop",
    "MATCH (c:customer)-[:in_nation]->(n)-[:in_region]->(r:region) RETURN c.id AS customer, n.title AS nation, r.title AS region",
    f"SELECT n0.id AS customer, n1.title AS nation, n2.title AS region FROM {_hop('in_nation', 'in_region')} WHERE n0.type = 'customer'",
)
_cypher(
    "cypher_three_hop",
    "MATCH (o:orders)-[:placed_by]->(c)-[:in_nation]->(n)-[:in_region]->(r) RETURN r.title AS region, count(o) AS orders",
    f"SELECT n3.title AS region, count(*) AS orders FROM {_hop('placed_by', 'in_nation', 'in_region')} GROUP BY 1",
)
_cypher("cypher_param", "MATCH (c:customer)-[:in_nation]->(n {id: $n}) RETURN c.id", f"SELECT n0.id AS \"c.id\" FROM {_hop('in_nation')} WHERE n0.type = 'customer' AND n1.id = 'nation/3'", {"n": "nation/3"})
_cypher("cypher_in", "MATCH (n) WHERE n.type IN ['region', 'nation'] RETURN n.id", "SELECT id AS \"n.id\" FROM nodes WHERE type IN ('region', 'nation')")
_cypher("cypher_unlabelled", "MATCH (a)-[:in_region]->(b) RETURN a.title AS a, b.title AS b", f"SELECT n0.title AS a, n1.title AS b FROM {_hop('in_region')}")
_cypher("cypher_type_fn", "MATCH (a)-[r]->(b) RETURN type(r) AS kind, count(r) AS n", f"SELECT e0.edge_type AS kind, count(*) AS n FROM {_hop('')} GROUP BY 1")
_cypher("cypher_rel_property", "MATCH (o:orders)-[r:contains]->(p) WHERE r.position >= 6 RETURN o.id, p.id, r.position", f"SELECT n0.id AS \"o.id\", n1.id AS \"p.id\", e0.position AS \"r.position\" FROM {_hop('contains')} WHERE e0.position >= 6")
_cypher(
    "cypher_count_group",
    "MATCH (c:customer)-[r:in_nation]->(n) RETURN n.title, count(r) AS c ORDER BY c DESC, n.title LIMIT 10",
    f"SELECT n1.title AS \"n.title\", count(*) AS c FROM {_hop('in_nation')} WHERE n0.type = 'customer' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10",
)
_cypher("cypher_limit_param", "MATCH (n:part) RETURN n.id AS i ORDER BY i SKIP 5 LIMIT $k", "SELECT id AS i FROM nodes WHERE type = 'part' ORDER BY i LIMIT 7 OFFSET 5", {"k": 7})
_cypher("cypher_whole_node", "MATCH (r:region) RETURN r", 'SELECT id AS "r.id", path AS "r.path", type AS "r.type", title AS "r.title" FROM nodes WHERE type = \'region\'')
_cypher("cypher_reverse", "MATCH (n:nation)<-[:in_nation]-(s:supplier) RETURN n.title AS nation, count(s) AS suppliers", f"SELECT n1.title AS nation, count(*) AS suppliers FROM {_hop('in_nation')} WHERE n0.type = 'supplier' GROUP BY 1")
_cypher(
    "cypher_boolean",
    "MATCH (n) WHERE (n.type = 'nation' OR n.type = 'region') AND NOT n.title STARTS WITH 'A' AND n.title CONTAINS 'A' RETURN n.title AS t",
    "SELECT title AS t FROM nodes WHERE type IN ('nation', 'region') AND NOT starts_with(title, 'A') AND contains(title, 'A')",
)
_cypher("cypher_distinct", "MATCH (o:orders)-[:placed_by]->(c)-[:in_nation]->(n) RETURN DISTINCT n.id", f"SELECT DISTINCT n2.id AS \"n.id\" FROM {_hop('placed_by', 'in_nation')}")
_cypher(
    "cypher_aggregates",
    "MATCH (o:orders)-[r:contains]->(p) RETURN o.title AS status, sum(r.position) AS s, min(r.position) AS lo, max(r.position) AS hi, count(DISTINCT p.id) AS parts",
    f"SELECT n0.title AS status, sum(e0.position)::BIGINT AS s, min(e0.position) AS lo, max(e0.position) AS hi, count(DISTINCT n1.id) AS parts FROM {_hop('contains')} GROUP BY 1",
)
_cypher(
    "cypher_shared_variable",
    "MATCH (c:customer)-[:in_nation]->(n), (s:supplier)-[:in_nation]->(n) WHERE s.id = 'supplier/1' RETURN c.id",
    "SELECT a.from_id AS \"c.id\" FROM edges a JOIN edges b ON a.to_id = b.to_id AND a.edge_type = 'in_nation' AND b.edge_type = 'in_nation' WHERE a.from_id LIKE 'customer/%' AND b.from_id = 'supplier/1'",
)
_cypher(
    "cypher_variable_length",
    "MATCH (c:customer)-[*1..2]->(x) RETURN x.type AS kind, count(x) AS n",
    f"SELECT kind, count(*) AS n FROM (SELECT n1.type AS kind FROM {_hop('')} WHERE n0.type = 'customer' UNION ALL SELECT n2.type FROM {_hop('', '')} WHERE n0.type = 'customer') GROUP BY 1",
)


@_query(f"WITH {_GRAPH_SQL} SELECT edge_type, count(*) AS count FROM edges GROUP BY 1")
def edge_types_count(spark, sf_dir):
    return ops.edge_type_counts(star_graph(spark, sf_dir).edges)


@_query(f"WITH {_GRAPH_SQL} SELECT edge_type, to_id, NULL::VARCHAR AS to_alias, true AS resolved, position FROM edges WHERE from_id = 'orders/7'")
def links(spark, sf_dir):
    return ops.links(star_graph(spark, sf_dir).edges, "orders/7.md")


@_query(f"WITH {_GRAPH_SQL} SELECT edge_type, from_id, n.type AS from_type, n.title AS from_title FROM edges e LEFT JOIN nodes n ON n.id = e.from_id WHERE to_id = 'nation/3' AND edge_type = 'in_nation'")
def backlinks(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return ops.backlinks(g.edges, g.nodes, "nation/3", "in_nation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-hop graph query: customers with their nation and region."""
    return QUERIES["cypher_two_hop"](spark, sf_dir)
