"""The registered queries on the driver's smallest tables."""

import glob
import os

import pytest

from quillmesh.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
COLUMNS = {
    "op1": {"doc_id", "item_id"},
    "op2": {"page_id", "host", "path", "rule", "verdict"},
    "op3": {"page_id", "url", "text", "n_chars"},
    "op4": {"doc_id", "held_out", "lang_pred", "score"},
    "op5": {"doc_id", "fingerprint", "component_id"},
    "op6": {"doc_id", "held_out", "score", "predicted"},
    "op7": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op8": {"doc_id", "text"},
    "op9": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op10": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    rows = df.collect()
    if not name.startswith("op1_"):
        table = "pages" if name[:4] in ("op2_", "op3_") else "documents"
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in ORACLE_SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
        want = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted(repr(tuple(r[n] for n in names)) for r in rows)
        assert got == sorted(map(repr, want.fetchall()))
