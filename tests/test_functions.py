import numpy as np
import pytest

from quillmesh.functions import chunker
from quillmesh.functions.blake3 import blake3, blake3_words
from quillmesh.functions.embedders import HashEmbedder, document_prompt, query_prompt
from quillmesh.functions.notes_parser import parse_note
from quillmesh.functions.text import find_wikilinks, snippet, split_frontmatter
from quillmesh.functions.yaml12 import parse_mapping, to_json_value

SPLITS = [
    ("---\na: 1\n---\nbody", "a: 1", "body"),
    ("no fence", None, "no fence"),
    ("---\na: 1\nbody", None, "---\na: 1\nbody"),
    ("---\n---\nbody", "", "body"),
    ("---\na: 1\n---", "a: 1", ""),
    ("---\r\na: 1\r\n---\r\nbody", "a: 1\r", "body"),
    ("---\na: 1\n---\n---text", "a: 1", "---text"),
    ("---\na: ---real\n---\nx", "a: ---real", "x"),
    ("", None, ""),
]
LINKS = [
    ("[[a/b]]", [("a/b", None)]),
    ("[[a|Alias]]", [("a", "Alias")]),
    ("[[a#head]]", [("a", None)]),
    ("[[a#head|B]]", [("a", "B")]),
    ("[[a^block]]", [("a", None)]),
    ("[[a]] and [[b, c d]]", [("a", None), ("b, c d", None)]),
    ("[[]] [x](y) [[ ]]", []),
]


@pytest.mark.parametrize(("text", "raw", "body"), SPLITS)
def test_frontmatter_split(text, raw, body):
    assert split_frontmatter(text) == (raw, body)


@pytest.mark.parametrize(("text", "found"), LINKS)
def test_wikilinks(text, found):
    assert find_wikilinks(text) == found


def test_column_forms_agree_with_python(spark):
    from pyspark.sql import functions as F

    from quillmesh.functions import text as T

    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SPLITS)], "i int, c string")
    got = {r.i: (r.raw, r.body) for r in rows.select("i", T.frontmatter_raw(F.col("c")).alias("raw"), T.body_of(F.col("c")).alias("body")).collect()}
    assert got == {i: (raw, body) for i, (_, raw, body) in enumerate(SPLITS)}
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(LINKS)], "i int, c string")
    got = {r.i: [(x.target, x.alias) for x in r.l] for r in rows.select("i", T.wikilinks(F.col("c")).alias("l")).collect()}
    assert got == {i: found for i, (_, found) in enumerate(LINKS)}
    rows = spark.createDataFrame(
        [("a\\b.md", "x\n# T  \n# U", " a\\b.md "), ("X.MD", "#no\n#  \n# later", "x/y.md.md"), ("d/e.f.md", "", "q")], "p string, b string, t string"
    )
    got = rows.select(T.note_id(F.col("p")), T.title_of(F.col("b"), F.col("p")), T.normal_target(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a/b", "T", "a/b"), ("X.MD", "X", "x/y.md"), ("d/e.f", "e.f", "q")]


def test_yaml_is_core_schema():
    value, warning = parse_mapping("d: 2026-05-10\ny: yes\nn: 012\nt: 12:30:00\nb: true\nz: ~\nf: 1.5\nl: [1, a]\n3: k")
    assert warning is None
    assert value == {"d": "2026-05-10", "y": "yes", "n": 12, "t": "12:30:00", "b": True, "z": None, "f": 1.5, "l": [1, "a"], 3: "k"}
    assert to_json_value({1: float("nan")}) == {"1": None}
    for bad in ("[unclosed", "- a\n- b", "a: 1\na: 2"):
        value, warning = parse_mapping(bad)
        assert value == {} and warning
    assert parse_mapping("  \n") == ({}, None)


def test_parse_note():
    note = parse_note("a\\b.md", "---\ntype: 5\nm: ['[[x]] [[y|Z]]', 3, {a: '[[no]]'}]\nk: '[[q]]'\n---\n## no\n# Yes \n")
    assert note["id"] == "a/b" and note["type"] is None and note["title"] == "Yes"
    assert [(e["edge_type"], e["to_raw"], e["to_alias"], e["position"]) for e in note["links"]] == [
        ("m", "x", None, 0), ("m", "y", "Z", 1), ("k", "q", None, 0),
    ]
    broken = parse_note("z.md", "---\n[oops\n---\nbody")
    assert broken["warning"] and broken["body"] == "body" and broken["title"] == "z"


def test_chunker_bounds():
    assert chunker.chunk_markdown("  \n\n") == [] and chunker.chunk_markdown(None) == []
    assert chunker.chunk_markdown("one\n\ntwo") == ["one\n\ntwo"]
    paragraph = "\n".join(f"line {i} " + "w" * 240 for i in range(10))
    found = chunker.chunk_markdown("\n\n".join([paragraph] * 3))
    assert len(found) == 3 and all(chunker.size(c) <= 480 + 2 + 3200 for c in found)
    assert found[1].startswith("line 9")
    fence = "```\n" + "\n\n".join(["code"] * 50) + "\n```"
    assert fence in chunker.chunk_markdown("f" * 3000 + "\n\n" + fence)[-1]
    long_line = chunker.chunk_markdown("x" * 10_000)
    assert "".join(c.split("\n\n")[-1] for c in long_line) == "x" * 10_000
    many = chunker.chunk_markdown("é" * 4000)
    assert all("�" not in c for c in many) and sum(c.count("é") for c in many) == 4000
    assert chunker.split_blocks("a\n# h\nb\n\nc") == ["a", "# h\nb", "c"]


def test_hard_split_keeps_pieces_of_a_long_line_apart():
    sizes = [chunker.size(p) for p in chunker.hard_split("a" * 4000 + "\nbbb")]
    assert sizes == [3200, 800, 3]
    assert chunker.hard_split("x\n" + "y" * 12 + "\nz\nw", 5) == ["x", "yyyyy", "yyyyy", "yy", "z\nw"]
    assert chunker.hard_split("éé\n" + "é" * 4, 5) == ["éé", "éé", "éé"]
    assert chunker.split_blocks("```\nopen\n\n") == ["```\nopen\n"]


def test_snippet():
    cut = snippet("é" * 300)
    assert cut.endswith("…") and len(cut[:-1].encode()) <= 280
    assert snippet("  short ") == "short" and snippet(None) == ""


def test_blake3_known_values():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    inputs = [b"", b"abc", b"x" * 64, b"y" * 200]
    assert [int(w).to_bytes(8, "little") for w in blake3_words(inputs)] == [blake3(x)[:8] for x in inputs]
    data = bytes(i % 251 for i in range(2048))
    assert blake3(data).hex().startswith("e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a")


def test_hash_embedder():
    e = HashEmbedder()
    a, b, c, zero = e.embed_documents([("", "red fish"), ("t", "Red, FISH!"), ("", "blue bird"), ("", "...")])
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not zero.any()
    assert a @ e.embed_query("fish") > c @ e.embed_query("fish")
    assert document_prompt("T", "x") == "title: T | text: x" and query_prompt("q") == "task: search result | query: q"
