import json
import os
import pathlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh import cli
from quillmesh.catalog import Catalog
from quillmesh.errors import CypherError, EmbeddingsMissing, IndexMissing, NoteNotFound, VaultNotFound
from quillmesh.functions.chunker import chunk_markdown
from quillmesh.functions.embedders import HashEmbedder
from quillmesh.operators import chunks, hybrid, notes, vector
from quillmesh.plans.cypher import PropertyGraph
from quillmesh.plans.embed_run import run_embed
from quillmesh.plans.index_run import run_index, save_postings
from quillmesh.sources import vault_files
from tests.conftest import write_notes

SOUP = "recipes/leek soup"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """One indexed vault for the tests that only read."""
    root = tmp_path_factory.mktemp("garden")
    write_notes(root)
    vault = Catalog(spark, str(tmp_path_factory.mktemp("home"))).add("garden", str(root))
    run_index(vault)
    return vault


def test_first_run_and_schema_discovery(vault):
    stats = run_index(vault)
    assert (stats.scanned, stats.added, stats.edges, stats.unresolved) == (11, 11, 14, 1)
    found = vault.ontology()
    assert found["types"] == {"bed": 2, "diary": 2, "list": 1, "person": 1, "plant": 2, "recipe": 2}
    assert found["edge_types"] == {"after": 1, "grows_in": 3, "likes": 2, "next_to": 1, "uses": 3, "variant_of": 1, "visits": 1, "wants": 2}


def test_lookups(vault):
    run_index(vault)
    soup = vault.get(SOUP + ".md")
    assert soup["frontmatter"] == {"type": "recipe", "serves": 4, "rated": "fair", "after": "[[diary/second week]]", "uses": ["[[plants/leek]]", "[[plants/potato.md]]"]}
    assert "body" not in soup and "blend" in vault.get(SOUP, body=True)["body"]
    assert {i: vault.get(i)["title"] for i in ("beds/south", "loose", "plants/leek")} == {"beds/south": "south", "loose": "loose", "plants/leek": "Leek"}
    for unknown in ("plants/garlic", "beds", ""):
        with pytest.raises(NoteNotFound):
            vault.get(unknown)
    assert vault.links("plants/garlic").collect() == []


def test_neighbours(vault):
    run_index(vault)
    out = [(r.edge_type, r.to_id, r.to_alias, r.resolved, r.position) for r in vault.links("people/ida, cook").collect()]
    assert out == [("likes", "recipes/fish pie", None, True, 0), ("likes", SOUP, "the soup", True, 1)]
    assert [(r.to_id, r.resolved) for r in vault.links("seeds", "wants").collect()] == [("plants/garlic", False), ("plants/leek", True)]
    assert vault.links("seeds", "uses").collect() == []
    back = {(r.edge_type, r.from_id, r.from_type, r.from_title) for r in vault.backlinks("plants/potato").collect()}
    assert back == {("uses", "recipes/fish pie", "recipe", "Fish pie"), ("uses", SOUP, "recipe", "Leek and potato soup")}
    assert {r.from_id for r in vault.backlinks("beds/north").collect()} == {"beds/south", "diary/spring, first week", "plants/leek", "plants/potato"}


def test_full_text_and_its_stored_index(vault, vault_dir):
    run_index(vault)
    rows = vault.search("leek soup", "recipe", 5).collect()
    assert [r.id for r in rows] == [SOUP] and rows[0].score > 0
    rows = vault.search("leek", limit=3).collect()
    assert len(rows) == 3 and rows[0].id == "plants/leek" and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    # the stored inverted index ranks the same, and is left when notes change
    save_postings(vault)
    assert vault.has_postings()
    assert [(r.id, round(r.score, 9)) for r in vault.search("leek", limit=3).collect()] == [(r.id, round(r.score, 9)) for r in rows]
    plan = vault.search("leek")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "In(term" in plan or "EqualTo(term" in plan
    (vault_dir / "chard.md").write_text("# Chard\n\nleek")
    run_index(vault)
    assert not vault.has_postings() and vault.search("chard").first().id == "chard"
    run_index(vault, postings=True)
    assert vault.has_postings() and vault.search("chard").first().id == "chard"


CYPHER = [
    ("MATCH (r:recipe)-[:uses]->(p:plant) RETURN r.id, p.id", 3),
    ("MATCH (r:RECIPE)-[:Uses]->(p) RETURN r.title, p.title", 3),
    ("MATCH (r:recipe)-[:uses]->(p)-[:grows_in]->(b:bed {id: 'beds/south'}) RETURN r.id, b.id", 2),
    ("MATCH (a)-[r]->(b) RETURN DISTINCT type(r) AS t ORDER BY t", 8),
    ("MATCH (b:bed)<-[g:grows_in]-(p) WHERE p.type IN ['plant', 'tree'] RETURN p.id, g.position", 3),
    ("MATCH (n) WHERE n.type IS NULL RETURN n.id", 1),
    ("MATCH (n) WHERE n.id STARTS WITH 'beds/' AND NOT n.title CONTAINS 'North' RETURN n.id", 1),
    ("MATCH (n:plant) RETURN n.id SKIP 1", 1),
    ("MATCH (x:recipe)-[*1..2]->(y) RETURN y.id", 13),
    ("MATCH (n:nothing) RETURN n.id", 0),
    ("MATCH (a:recipe)-[:uses]->(p), (s:list)-[:wants]->(p) RETURN a.id, s.id", 1),
    ("MATCH (p:plant)-[:grows_in]->(b) RETURN p.id, collect(b.id) AS beds", 2),
]


@pytest.mark.parametrize(("text", "rows"), CYPHER)
def test_cypher_counts(indexed, text, rows):
    assert indexed.query(text).count() == rows


def test_cypher_values_and_errors(indexed):
    q = indexed.query
    found = q("MATCH (x)-[r]->(b:bed) RETURN b.id, count(r) AS c ORDER BY c DESC, b.id LIMIT 1").collect()
    assert [(r["b.id"], r.c) for r in found] == [("beds/north", 4)]
    assert q("MATCH (r:recipe)-[:uses]->(p {id: $plant}) RETURN r.id", {"plant": "plants/leek"}).first()[0] == SOUP
    assert q("MATCH (n) RETURN n").columns == ["n.id", "n.path", "n.type", "n.title"]
    plan = q("MATCH (r:recipe)-[:uses]->(p) RETURN r.id, p.id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "body" not in plan
    for bad in ("MATCH (n RETURN n", "MATCH (n) RETURN n.body", "MATCH (n) RETURN m.id", "MATCH (n) RETURN n.id LIMIT x", "RETURN 1"):
        with pytest.raises(CypherError):
            q(bad)


def rows_made(df):
    """The result's rows and the most rows that any step of its plan gave."""
    run, most = df._jdf.queryExecution(), 0
    rows, plans = run.toRdd().count(), [run.executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            made = plan.metrics().get("numOutputRows")
            most = max(most, made.get().value() if made.isDefined() else 0)
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, most


HUB = [
    ("MATCH (p:person)-[:lives_in]->(t), (c:club)-[:lives_in]->(t) WHERE c.id = 'club/1' RETURN p.id", 300),
    ("MATCH (p:person)-[:lives_in]->(t), (c:club {title: 'C7'})-[:lives_in]->(t) RETURN p.id", 300),
    ("MATCH (p:person)-[:lives_in]->(t)<-[:lives_in]-(c) WHERE c = $c AND p.title <> 'P3' RETURN p.id", 299),
    ("MATCH (p:person)-[:lives_in]->(t)<-[:lives_in]-(x:town) RETURN p.id", 0),
    ("MATCH (p:person)-[:lives_in]->(t {id: 'town/0'}), (c:club {id: 'club/2'})-[:lives_in]->(t) WHERE p.id = 'person/5' RETURN p.id, c.id", 1),
    ("MATCH (p:person)-[:lives_in]->(t), (c:club)-[:lives_in]->(t) WHERE c.id = 'club/1' AND c.id = 'club/2' RETURN p.id", 0),
    ("MATCH (p:person)-[*1..2]->(t)<-[:lives_in]-(c:club {id: 'club/1'}) RETURN p.id", 300),
]


@pytest.mark.parametrize(("text", "rows"), HUB)
def test_a_hub_is_not_squared(spark, text, rows):
    def of(kind, n):
        key = f"concat('{kind}/', id)"
        return spark.range(n).selectExpr(f"{key} AS id", f"concat({key}, '.md') AS path", f"'{kind}' AS type", f"concat('{kind[0].upper()}', id) AS title")

    folk = of("person", 300).union(of("club", 300))
    edges = folk.selectExpr("id AS from_id", "'lives_in' AS edge_type", "'town/0' AS to_id", "'' AS to_raw", "true AS resolved", "0 AS position")
    found = PropertyGraph(folk.union(of("town", 1)), edges).query(text, {"c": "club/1"})
    got, most = rows_made(found)
    assert got == rows and most <= 1000


def test_incremental_runs(vault, vault_dir):
    run_index(vault)
    again = run_index(vault)
    assert (again.unchanged, again.added, again.updated, again.removed) == (11, 0, 0, 0)
    path = vault_dir / "diary" / "second week.md"
    os.utime(path, (5, 5))
    assert run_index(vault).unchanged == 11  # touched, but the same
    path.write_text("---\ntype: diary\nvisits: ['[[beds/north]]', '[[beds/south]]']\n---\nSowed marrowfat peas.\n")
    (vault_dir / "plants" / "garlic.md").write_text("---\ntype: plant\n---\n")
    stats = run_index(vault)
    assert (stats.added, stats.updated, stats.unchanged, stats.removed, stats.edges) == (1, 1, 10, 0, 16)
    assert vault.search("marrowfat").first().id == "diary/second week" and vault.search("rain").count() == 0
    # links are looked up again when their source changes, or in a full run
    assert not vault.links("seeds", "wants").first().resolved
    assert run_index(vault, full=True).unresolved == 0 and vault.links("seeds", "wants").first().resolved
    (vault_dir / "beds" / "north.md").unlink()
    stats = run_index(vault)
    assert (stats.removed, stats.edges) == (1, 16)
    stats = run_index(vault, full=True)
    assert (stats.added, stats.removed, stats.unresolved) == (11, 0, 5)
    (vault_dir / "broken.md").write_bytes(b"\xff\xfe")
    assert run_index(vault).scanned == 12 and vault.notes().count() == 11


def test_empty_vault(spark, tmp_path):
    (tmp_path / "e").mkdir()
    v = Catalog(spark, str(tmp_path / "h")).add("e", str(tmp_path / "e"))
    assert run_index(v).scanned == 0 and v.search("x").count() == 0


def test_versions_share_parts_and_outlive_commits(vault, vault_dir):
    run_index(vault)
    before, old = vault.notes(), vault.store.current()
    (vault_dir / "loose.md").write_text("# Now with a title\n")
    run_index(vault)
    now = vault.store.current()
    changed = vault.store.touched(vault.notes().where("id = 'loose'").select("id"))
    assert [int(p) for p in now["notes"] if now["notes"][p] != old["notes"].get(p)] == changed
    # opened before the commit, read after it
    assert {r.id: r.title for r in before.collect()}["loose"] == "loose" and vault.get("loose")["title"] == "Now with a title"
    for i in range(4):
        (vault_dir / "loose.md").write_text(f"# Title {i}\n")
        run_index(vault)
    # parts of versions that are no longer kept are gone, those of the first run that nothing replaced aren't
    folders = {p.name for p in pathlib.Path(vault.store.root).iterdir() if p.name.startswith("notes-")}
    assert len(folders) == 4 and vault.notes().count() == 11
    assert [int(p) for p in vault.store.current()["notes"] if vault.store.current()["notes"][p] != old["notes"][p]] == changed


def test_embedding_runs(vault, vault_dir):
    model = HashEmbedder()
    run_index(vault)
    with pytest.raises(EmbeddingsMissing):
        vault.similar("peas")
    first = run_embed(vault, model)
    assert (first.scanned, first.embedded) == (11, 11) and first.total_chunks == vault.embeddings().count() == 11
    assert (run_embed(vault, model).embedded, run_embed(vault, model).chunks_written) == (0, 0)
    (vault_dir / "diary" / "second week.md").write_text("---\ntype: diary\n---\nSowed marrowfat peas.\n")
    (vault_dir / "loose.md").unlink()
    run_index(vault)
    stats = run_embed(vault, model)
    assert (stats.scanned, stats.embedded, stats.unchanged, stats.removed) == (10, 1, 9, 1)
    model.model_id = "another"
    assert run_embed(vault, model).embedded == 10


class OneBatch:
    """In place of a DataFrame: runs the function on one Arrow batch, here."""

    def __init__(self, batch):
        self.batch, self.columns = batch, batch.schema.names

    def select(self, *names):
        return OneBatch(self.batch.select(list(names)))

    def mapInArrow(self, run, schema):
        return run(iter([self.batch]))

    def mapInPandas(self, run, schema):
        return run(iter([self.batch.to_pandas()]))


class ZeroEmbedder:
    model_id, dim = "zero", 768

    def embed_documents(self, pairs):
        return np.zeros((len(pairs), 768), np.float32)


STEPS = {
    "cut": lambda t: chunks.chunk_notes(t),
    "embed": lambda t: chunks.embed_chunks(t, ZeroEmbedder(), 0),
    "cut and embed": lambda t: chunks.embed_notes(t, ZeroEmbedder(), 0),
    "parse": lambda t: vault_files.parse_contents(t),
}


@pytest.mark.parametrize("step", STEPS)
def test_what_python_holds_does_not_grow_with_a_batch(step):
    def peak(n):
        ids, text = [f"n{i}" for i in range(n)], [f"{i} " + "word " * 800 for i in range(n)]
        named = dict.fromkeys(("id", "note_id", "rel", "title", "content_hash"), ids) | {"body": text, "chunk_text": text, "seq": [0] * n}
        table = OneBatch(pa.RecordBatch.from_pydict(named | {"content": ["---\ntype: t\n---\n" + t for t in text]}))
        del text, named
        tracemalloc.start()
        try:
            rows = sum(num_rows(b) for b in STEPS[step](table))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    def num_rows(b):
        return b.num_rows if isinstance(b, pa.RecordBatch) else len(b)

    peak(50)
    (few, low), (many, high) = peak(1000), peak(5000)
    assert many == 5 * few >= 5000
    # parsing takes frames: their 4000 more texts of 4 KB count once, what is made of them doesn't
    assert high < (low + 4000 * 6000 if step == "parse" else 1.5 * low)


def test_notes_are_embedded_alike_in_one_pass_and_in_two(spark):
    rows = [("a", "A", "one two\n\n" * 900, "h1"), ("b", "Title only", " \n", "h2"), ("c", "C", None, "h3"), ("d", "D", "\u00e9\U0001f331 " * 3000, None)]
    table = spark.createDataFrame(rows, "id string, title string, body string, content_hash string")
    one, two = chunks.embed_notes(table, HashEmbedder(), 7), chunks.embed_chunks(chunks.chunk_notes(table), HashEmbedder(), 7)
    key = lambda r: (r.note_id, r.seq)
    got = sorted(one.collect(), key=key)
    assert one.schema == two.schema and got == sorted(two.collect(), key=key)
    assert [(r.note_id, r.seq, r.chunk_text) for r in got if r.note_id in "bc"] == [("b", 0, "Title only"), ("c", 0, "C")]
    assert all(len(r.vector) == 768 and r.embedded_at_ms == 7 for r in got)
    for note_id, title, body, h in rows:
        mine = [r for r in got if r.note_id == note_id]
        assert [r.chunk_text for r in mine] == (chunk_markdown(body) or [title])
        assert [r.seq for r in mine] == list(range(len(mine))) and {r.content_hash for r in mine} == {h}
        assert np.array_equal([r.vector for r in mine], HashEmbedder().embed_documents([("", r.chunk_text) for r in mine]).astype(float))


def test_similar_and_hybrid(vault):
    model = HashEmbedder()
    run_index(vault)
    run_embed(vault, model)
    top = vault.similar("sandy soil dries", embedder=model).first()
    assert (top.id, top.type, top.snippet) == ("beds/south", "bed", "Sandy soil, dries out.")
    typed = vault.similar("leek", "recipe", embedder=model).collect()
    assert typed and {r.type for r in typed} == {"recipe"}
    best = vault.hybrid("leek soup", limit=4, embedder=model).collect()
    assert best[0].id == SOUP and best[0].bm25_score > 0 and len(best) == 4


def test_rank_fusion(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = [r.id for r in hybrid.fuse(a, b).orderBy(F.desc("score")).collect()]
    assert got[0] == "b" and got[1:] == ["a", "c"]
    assert abs(hybrid.fuse(a).where("id = 'a'").first().score - 1 / 61) < 1e-12


def test_resolution(spark):
    ids = spark.createDataFrame([("a/one",), ("x, y/two b",), ("p/same",), ("q/same",)], "id string")
    raw = spark.createDataFrame(
        [("s", "t", w, None, i) for i, w in enumerate(["a/one", "one", "same", "gone", " a\\one.md ", "wrong/two b"])],
        "from_id string, edge_type string, to_raw string, to_alias string, position int",
    )
    got = {r.position: (r.to_id, r.resolved) for r in notes.resolve_links(raw, ids).collect()}
    assert got == {
        0: ("a/one", True), 1: ("a/one", True), 2: ("same", False), 3: ("gone", False), 4: ("a/one", True), 5: ("x, y/two b", True),
    }


def test_vector_checks(spark):
    rows = spark.createDataFrame([("a", 0, "x", [1.0, 0.0]), ("b", 0, "y", [0.0, 0.0])], "note_id string, seq int, chunk_text string, vector array<float>")
    got = {r.note_id: r.similarity for r in vector.nearest(rows, [2.0, 0.0], 5).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    with pytest.raises(Exception, match="dimensions"):
        vector.nearest(rows, [1.0], 5).collect()


def test_streaming_ingest(spark, vault, tmp_path):
    from quillmesh.streaming.ingest import ingest

    source = tmp_path / "in"
    schema = "rel string, content string, mtime_ms bigint, size_bytes bigint"
    rows = [("a.md", "---\ntype: t\nsee: '[[b]]'\n---\n# A", 1, 10), ("b.md", "# B", 1, 3), ("a.md", "---\ntype: t\n---\n# A2", 2, 10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    q = ingest(vault, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.title) for r in vault.notes().collect()} == {("a", "A2"), ("b", "B")} and vault.edges().count() == 0


def test_command_line(spark, tmp_path, vault_dir, capsys):
    home = str(tmp_path / "cfg")

    def run(*args):
        status = cli.main(["--config", home, *args], spark)
        out = capsys.readouterr()
        return status, json.loads(out.out) if out.out.strip() else json.loads(out.err)

    assert run("types")[0] == 3
    assert run("vault", "add", "v", str(vault_dir))[0] == 0
    assert run("types")[0] == 5 and run("get", "x")[0] == 5
    assert run("index")[1]["added"] == 11
    assert run("get", "x") == (4, {"error": {"code": "note_not_found", "message": "no note x"}})
    assert run("types", "--vault", "other")[0] == 3
    assert run("similar", "x")[0] == 6 and run("search", "x", "--hybrid")[0] == 6
    status, found = run("query", "MATCH (r:recipe {id: $i}) RETURN r.title AS t", "--param", f"i={SOUP}")
    assert status == 0 and found == {"columns": ["t"], "rows": [{"t": "Leek and potato soup"}]}
    assert run("query", "MATCH (")[0] == 1
    assert run("edges")[1][0] == {"edge_type": "after", "count": 1}
    assert {r["from_title"] for r in run("backlinks", SOUP)[1]} == {"Fish pie", "ida, cook"}
    assert run("vault", "list")[1][0]["default"] is True
    assert run("vault", "remove", "v")[0] == 0 and run("vault", "list")[1] == []


def test_gates(spark, tmp_path, vault):
    with pytest.raises(IndexMissing):
        vault.notes()
    with pytest.raises(VaultNotFound):
        Catalog(spark, str(tmp_path / "none")).vault()
