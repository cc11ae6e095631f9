import glob
import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def load_entry():
    spec = importlib.util.spec_from_file_location("entry_under_test", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names_agree():
    entry = load_entry()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45


def test_entry_without_the_optional_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quillmesh.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("quillmesh.llm") or name == "corpus_pipeline":
                raise ImportError(name)

    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    import quillmesh

    monkeypatch.delattr(quillmesh, "llm", raising=False)
    names = load_entry().queries()
    assert "cypher_two_hop" in names and not any(n.startswith("op") for n in names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["types_count", "link_resolution", "bm25_search", "similar_best_chunk", "hybrid_rrf", "cypher_shared_variable", "notes_upsert"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    entry = load_entry()
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*(f"`{n}`" for n in names)).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_plans(spark):
    queries = load_entry().queries()

    def plan(name):
        return queries[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    hop = plan("cypher_one_hop")
    assert "Cartesian" not in hop and "BroadcastNestedLoop" not in hop
    assert "p_partkey" not in hop and "l_orderkey" not in hop  # labels and types prune the other tables
    assert "TakeOrderedAndProject" in plan("bm25_search_typed")
    point = plan("get_note")
    assert "n_chars" not in point and "lang" in point
    index = plan("bm25_postings")
    assert "lang" not in index and "n_chars" not in index  # pruned to what the index needs
