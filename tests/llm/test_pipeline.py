"""The pipeline, each stage against a brute-force version on its own input."""

import pytest

import corpus_pipeline
from quillmesh.llm import line_dedup
from tests.llm.brute import encode_ids
from tests.llm.test_operators import DOCS, brute_components, brute_contained, brute_fingerprint, brute_lines, words


@pytest.fixture
def folder(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    base = [words(60) + ". " + words(30) for _ in range(40)]
    item = words(25)
    texts = [f"Site menu\n{t}\nfooter {i % 50}" for i, t in enumerate(base)]
    texts += [texts[3], texts[4], "", None, "12345 !!", base[0] + " " + item + " " + words(40), "Site menu", words(1), "Site menu\nSite menu"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 2}", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, item), (1, None), (2, words(30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict(items)


def test_stages(spark, folder, tmp_path):
    sf_dir, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"out{number}"))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / f"out{number}"))
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
        if number < 4:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    before, after = seen["language ID"]
    gone = set(before) - set(after)
    assert gone == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
    before, after = seen["line dedup"]
    order = sorted(before)
    want = dict(zip(order, brute_lines([(before[i].source, before[i].text) for i in order])))
    kept = {i: t for i, (t, _, dropped) in want.items() if not dropped or t.strip(line_dedup.BLANKS + "\n")}
    assert {i: r.text for i, r in after.items()} == kept and len(kept) < len(before)
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen["SimHash near-dedup"]
    order = sorted(before)
    ids = brute_components([brute_fingerprint(before[i].text) for i in order])
    assert set(after) == {order[c] for c in ids} and len(after) < len(before)
    before, after = seen["benchmark decontamination"]
    order, names = sorted(before), sorted(items)
    leaks = {order[d] for d, *_ in brute_contained([before[i].text for i in order], [items[n] for n in names])}
    assert leaks and set(after) == set(before) - leaks
    before, after = seen["byte-level BPE"]
    assert all(list(after[i].ids) == encode_ids(before[i].text) and after[i].round_trip for i in before) and set(after) == set(before)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: tuple(r.ids) for r in whole.collect()} == {i: tuple(r.ids) for i, r in after.items()}


def test_stages_on_an_empty_table(spark, folder):
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_line_dedup_keeps_a_text_that_is_a_third_of_its_source(spark):
    copied = words(40) + "\n" + words(30)
    texts = [f"Site menu\n{words(50)}" for _ in range(40)] + [copied, copied + "\n", copied.replace("\n", " \n\n")] * 7 + [None, None, ""]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {i: t and t.replace("Site menu\n", "") for i, t in enumerate(texts)}


def test_near_dedup_of_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (words(60) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, b), (None, a), (None, c), (None, c), (3, d), (0, d), (0, d.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], DOCS)
    runs = [sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert [(i, t.lower()) for _, i, t in runs[0]] == sorted([(0, d), *sorted([(1, a), (1, b)])]) + [(0, c)]
