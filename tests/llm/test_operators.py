"""Every operator on small fixtures: brute force, edge cases, held-out accuracy."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import bpe, common, decontaminate, html_extract, langid, line_dedup, quality, simhash, suffix_dedup, toxicity, url_filter
from quillmesh.llm.components import connected_components
from quillmesh.llm.shingles import plain_words, shingle_hashes
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
RNG = random.Random(5)
SYLLABLES = ["ka", "to", "mi", "ra", "ne", "lo", "shu", "pe"]


def words(n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def stored(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


EDGE = [None, "", " \n\t ", "one", "ééé 世界", "a\n\na\n", "word " * 3000, "same text here", "same text here"]


# ---- 1 decontamination -----------------------------------------------------


def brute_contained(texts, items, k=5, t=0.8):
    found = set()
    for d, text in enumerate(texts):
        w = plain_words(text)
        for i, item in enumerate(items):
            v = plain_words(item)
            if not v:
                continue
            n = min(k, len(v))
            own = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if len(own & have) >= t * len(own) - 1e-9:
                found.add((d, i, len(own), len(own & have)))
    return found


def test_decontamination(spark):
    items = [words(30), words(12), "two words", None, "", words(7), "x", words(60)]
    texts = [*EDGE, words(500) + " " + items[0].upper() + ", " + words(20), items[1], "the two words!", items[5] + " tail"]
    partial = items[7].split()
    texts += [" ".join(partial[:52]), " ".join(partial[:30]) + " cut " + " ".join(partial[30:]), " ".join(partial[:40]), words(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.contained_items(docs_of(spark, texts), df).collect()
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == brute_contained(texts, items)
    blocks = decontaminate.contained_items(docs_of(spark, texts), df, block_bytes=300).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    for rows in (1_000_000, 0):
        left = {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, texts), df, broadcast_rows=rows).collect()}
        assert left == set(range(len(texts))) - {r.doc_id for r in got}
    assert decontaminate.contained_items(docs_of(spark, texts), df.limit(0)).count() == 0


def test_decontamination_finds_all_in_every_size_partition(spark):
    """Recall by size partition, items cut to just the share that counts, in blocks of few."""
    rng = random.Random(3)
    items = [words(n, rng) for n in (5, 6, 7, 9, 12, 17, 25, 40, 70, 130, 260) for _ in range(4)]
    texts = []
    for item in items:
        own = item.split()
        n = max(1, len(own) - 4)
        keep = int(np.ceil(0.8 * n - 1e-9)) + 4
        at = rng.randrange(len(own) - keep + 1)
        texts += [" ".join([words(400, rng), *own[at : at + keep], words(300, rng)]), " ".join([words(400, rng), *own[at : at + keep - 2], words(300, rng)])]
    df = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.contained_items(docs_of(spark, texts), df, block_bytes=1000).collect()}
    want = brute_contained(texts, items)
    assert got == want and {i for _, i, _, _ in want} == set(range(len(items)))
    block = decontaminate.Block(enumerate(items), 5, 0.8)
    assert len(block.partitions[5]) == 9  # 1, 2, 3-4, 5-8, 9-16, 17-32, 33-64, 65-128 and 129-256 shingles
    # the driver holds one block of items at a time
    held = [len(b) for b in decontaminate.item_blocks(df, "item_id", "text", 2000)]
    assert sum(held) == len(items) and len(held) > 5 and max(held) < len(items) // 2
    none = docs_of(spark, [])
    assert decontaminate.contained_items(none, df).collect() == [] and decontaminate.decontaminate(none, df).collect() == []


@pytest.mark.parametrize("n", range(1, 70))
def test_sketch_never_misses(n):
    missing = n - int(np.ceil(0.8 * n - 1e-9))
    assert decontaminate.sketch_size(n, 0.8) >= min(n, missing + 1)


# ---- 2 URLs ----------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = ""
    for c in rest[len(host) :]:
        if c in "?#":
            break
        path += c
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in url_filter.GIVEN_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "nothing", "http://", "http://A.ORG", "http://a.org/", "http://www.Example.org/es/1?x=1", "https://example.org/en/12#t",
    "https://example.org/en/2", "https://notexample.org/es/", "ftp://x.com/fr/", "http://x.com/de", "http://x.com/de/?a", "http://com/de/9",
    "a://b://c.org/d", "http://é.org/é\n/x", "http://x.org?y/z", "http://u@h.com:80/fr/",
]


def test_given_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], url_filter.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, none).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def brute_tokens(url):
    host, path, *_ = brute_url(url)
    labels = host.split(".")
    found = {"h:" + x for x in labels} | {"w:" + y for x in labels if "-" in x for y in x.split("-")}
    found |= {"p:" + re.sub(r"\d+", "0", x.lower()) for x in re.split(r"[/.\-_]", path)}
    found |= {"q:" + x for x in re.findall(r"[?&]([^=&#]+)=", url or "")}
    return {x for x in found if len(x) > 2}


def brute_rules(labelled, min_support, min_lift, z):
    """Every set of tokens of every labelled URL, counted."""
    rows = [(brute_tokens(u), "block" if bad else "allow") for u, bad in labelled if u is not None and bad is not None]
    share = {v: sum(w == v for _, w in rows) / len(rows) for v in ("block", "allow")}
    counts = Counter()
    for own, v in rows:
        for n in range(1, len(own) + 1):
            for some in itertools.combinations(sorted(own), n):
                counts[some, v] += 1
    rules = {}
    for (some, v), hits in counts.items():
        n = hits + counts[some, "allow" if v == "block" else "block"]
        p = hits / n
        bound = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if hits >= min_support * len(rows) - 1e-9 and p >= max(0.7, min_lift * share[v]) - 1e-12 and bound > share[v]:
            rules[some, v] = bound / share[v]
    kept = {
        (some, v): s for (some, v), s in rules.items()
        if not any(v == w and set(part) < set(some) and rules[part, w] >= s - 1e-12 for part, w in rules)
    }
    weakest = min((s for (_, v), s in kept.items() if v == "block"), default=None)
    return {k: s for k, s in kept.items() if weakest is not None and (k[1] == "block" or s >= weakest)}


def brute_verdict(url, rules):
    fired = [(s, v == "allow") for (some, v), s in rules.items() if set(some) <= brute_tokens(url)]
    return ("allow" if max(fired)[1] else "block") if fired else None


def url_tables(seed):
    rng = random.Random(seed)
    hosts = ["www.casino-win.net", "m.casino-win.net"] * seed * 2 + ["good.net", "play-good.net", "news.com", "www.x-y.com"]

    def one():
        url = f"http://{rng.choice(hosts)}/{rng.choice(['win', 'read', 'Win'])}/{rng.choice(['a', 'b_c', '7'])}?{rng.choice(['q=1', 'r=2', ''])}"
        return url, rng.random() < (0.9 if "casino" in url and "read" not in url else 0.1)

    return [one() for _ in range(300)], [one()[0] for _ in range(100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_url_rules_equal_brute_force(spark, seed):
    labelled, urls = url_tables(seed)
    table = spark.createDataFrame([*labelled, (None, True), ("http://x.net/", None)], "url string, bad boolean")
    rules = url_filter.mine_rules(table, min_support=0.02, sureness=2.0)
    want = brute_rules(labelled, 0.02, 1.2, 2.0)
    assert {(tuple(r.tokens), r.verdict): round(r.strength, 9) for r in rules.collect()} == {k: round(s, 9) for k, s in want.items()}
    assert {v for _, v in want} == {"block", "allow"}
    rows = [*urls, *URLS, urls[0], "http://casino-win.net/" + "long/" * 20_000]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.method) for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in enumerate(rows):
        given, mined = brute_url(u)[3], brute_verdict(u, want)
        assert got[i] == ((given, "given") if given else (mined, "mined") if mined else ("allow", "default")), u
    assert sum(m == ("block", "mined") for m in got.values()) > 10


def test_url_labels_without_signal_give_no_rules(spark):
    """Pure chance makes combinations of confidence 1: none is taken for a rule."""
    rng = random.Random(4)
    labelled = [(f"http://{words(1, rng)}.net/{words(1, rng)}/{words(1, rng)}?{rng.choice('abc')}=1", rng.random() < 0.25) for _ in range(500)]
    table = spark.createDataFrame(labelled, "url string, bad boolean")
    assert url_filter.mine_rules(table).collect() == []
    assert url_filter.mine_rules(table.where("bad")).collect() == [] and url_filter.mine_rules(table.limit(0)).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, verdict string")
    assert url_filter.judge_urls(pages, url_filter.mine_rules(table)).collect() == []


def test_mined_url_rules_of_four_tokens(spark):
    """Tokens that only together tell: no shorter rule is as strong."""
    rows = [("http://x.net/ab/cd/ef/gh", True)] * 30
    rows += [("http://x.net/" + "/".join(p for p in ("ab", "cd", "ef", "gh") if p != gone), False) for gone in ("ab", "cd", "ef", "gh") for _ in range(30)]
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), min_support=0.05)
    mined = {(tuple(r.tokens), r.verdict) for r in rules.collect()}
    assert {t for t, v in mined if v == "block"} == {("p:ab", "p:cd", "p:ef", "p:gh")}
    pages = spark.createDataFrame([(1, rows[0][0]), (2, rows[30][0])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "allow"}


# ---- 3 HTML ----------------------------------------------------------------


def page(body, n):
    return (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>"
        f'<header>Site</header><nav><ul><li><a href="/">Home {n}</a></ul></nav><div class="ad">Buy {n}</div>'
        f"<article><h1>Head &amp; {n}</h1>{body}<p>Share this page with friends</p><div class='comments'><p>Nice {n}</p></div></article>"
        f'<aside>Side {n}</aside><form><p>Mail</p></form><!-- no <p>comment</p> --><footer>Foot {n}</footer></body></html>'
    )


def test_html_extraction(spark):
    rows = [(i, f"http://h.net/{i}", page(f"<p><b>One{i}<br> two&nbsp;x<p>Three{i} <i>in</i>line</p><ul><li>a{i}<li>b</ul>", i)) for i in range(8)]
    rows += [(100, None, None), (101, "http://solo.net/", page("<p>Only</p>", 0)), (102, "x", "just text &lt; here"), (103, "http://h.net/e", ""), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in html_extract.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    # what stands in an article stays, even if it is the same on all pages of the host
    assert got[3] == ["Head & 3\n\nOne3 two x\n\nThree3 inline\n\na3\n\nb\n\nShare this page with friends"]
    assert len(got[0]) == 2 and got[0][0] == got[0][1]
    assert got[100] == [""] and got[103] == [""] and got[102] == ["just text < here"]
    assert got[101] == ["Head & 0\n\nOnly\n\nShare this page with friends"]
    small = html_extract.extract(df, broadcast_bytes=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, html_extract.extract(df).collect()))


PROSE = "Long prose of the article."


@pytest.mark.parametrize(
    "shown",
    [
        "<body class='single right-sidebar'><article><p>{}</p></article></body>",
        "<body class='sidebar'><p>{}</p></body>",
        "<html class='search'><body id='menu'><main class='widget'><p>{}</p></main></body></html>",
        "<div id='page' class='has-sidebar'><p>{}</p></div>",
        "<div id='page' class='sidebar'><nav>Menu</nav><article><p>{}</p></article></div>",
        "<form id='search'><div class='overlay'><article><p>{}</p></article></div></form>",
        "<article class='post comments-open'><p>{}</p></article>",
        "<article class='promo'><p>{}</p></article>",
        "<div class='post'><p>{}</p></div><div class='comments'><article class='comment'>Nice one, and so very much longer than it</article></div>",
        "<div class='post'><p>{}</p></div><aside><article>A teaser that is far longer than all the prose of the page</article></aside>",
        "<article><p>{}</p><div class='comments'><article class='comment'>Nice</article></div></article>",
        "<main><article><p>{}</p></article><div id='comments'>Nice</div><div class='related-posts'>More</div></main>",
    ],
)
def test_html_class_names_of_containers(shown):
    assert html_extract.content_text(shown.format(PROSE)) == PROSE


def test_html_class_names_within_the_article():
    inner = (
        "<div class='header'><h1 class='banner'>Title</h1></div><h2 id='related-work'>Related work</h2><h2 id='search'>Search</h2><p>See <a class='related'>this</a> now</p>"
        "<section id='related'><p>More</p></section><div class='no-comments'>Kept</div><div class='ad'>Buy</div>"
    )
    assert html_extract.content_text(f"<article>{inner}</article>") == "Title\n\nRelated work\n\nSearch\n\nSee this now\n\nMore\n\nKept"
    outside = "<div id='sidebar'>Side</div><span class='ad'>Buy</span><div class='header'>Site</div><p>See <a class='related'>this</a></p>"
    assert html_extract.content_text(f"<body>{outside}</body>") == "See this"


def anonymous(n, names):
    """A page whose elements and class names say nothing about its parts."""
    one, two, three = names
    return (
        f'<body><div class="{one}"><div class="x"><a href="/">Home</a> <a href="/n">News of {n % 3}</a></div>'
        f'<div class="{two}"><h1>Title {n}</h1><p>{PROSE} Number {n}.</p><div class="y">Read on at our site</div><p>More of {n}: {PROSE * 3}</p></div>'
        f'<div class="{three}">Rotating offer {n % 4}</div></div><div class="z">Imprint of the firm</div></body>'
    )


def test_html_wrapper_decides(spark):
    """Only the alignment of a host's pages tells its article from the rest."""
    rows = [(i, f"http://w.net/{i}", anonymous(i, ("ka", "kb", "kc"))) for i in range(12)]
    rows += [(20 + i, f"http://v.net/{i}", re.sub(" class=.[a-z0-9]*.", "", anonymous(i, ("", "", "")))) for i in range(12)]
    rows += [(50, "http://w.net/other", "<body><table><tr><td>A page unlike the others</td></tr></table></body>")]
    rows += [(60 + i, "http://copies.net/", f"<div class='a'>Offer {i}</div><article><p>{PROSE}</p></article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.found_by) for r in html_extract.extract(df).collect()}
    for i in range(12):
        assert got[i] == (f"Title {i}\n\n{PROSE} Number {i}.\n\nMore of {i}: {PROSE * 3}", "wrapper")
        assert got[20 + i][1] == "wrapper" and got[20 + i][0].startswith(f"Title {i}\n\n") and "Rotating" not in got[20 + i][0] and "Home" not in got[20 + i][0]
    assert got[50] == ("A page unlike the others", "page")
    # copies of an article are no template, and what differs beside it no content
    assert {got[60 + i][0] for i in range(30)} == {PROSE}
    alone = {r.page_id: r.text for r in html_extract.extract(df, induce=False).collect()}
    assert all("Imprint" in alone[i] and alone[i] != got[i][0] for i in range(12))
    # the same however the pages are dealt to tasks
    for parts in (1, 7):
        again = html_extract.extract(df.repartition(parts, F.xxhash64("page_id")))
        assert {r.page_id: (r.text, r.found_by) for r in again.collect()} == got


def test_html_edge_tables(spark):
    schema = "page_id long, url string, html string, host string, text string"
    assert html_extract.extract(spark.createDataFrame([], schema)).collect() == []
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(None, None, None, "c", "c"), (1, "http://e.net/", "<div>" * 5000 + "deep", "c", "c"), (2, "http://e.net/", long, "c", "c"), (2, "http://e.net/", long, "c", "c")]
    got = sorted((r.page_id or 0, r.n_chars, r.text[:4]) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, ""), (1, 4, "deep"), (2, 999_999, "word"), (2, 999_999, "word")]


@pytest.mark.parametrize(
    ("page", "end"),
    [
        ("<div>" * 200_000 + "end", "end"),
        ("<a b " * 200_000, "<a b"),
        ("<b>" * 100_000 + "</i>" * 100_000 + "end", "end"),
        ("<p title=\"x>" * 50_000 + "end", "end"),
        ("<script " * 100_000, "<script"),
        ("<li>x" * 100_000, "x"),
        ("<!-- " * 100_000, ""),
    ],
)
def test_html_reads_in_linear_time(page, end):
    began = time.perf_counter()
    assert html_extract.content_text(page).endswith(end)
    assert time.perf_counter() - began < 10


def brute_match(a, b):
    """Simple tree matching by its recurrence, every pair of children."""
    if a[0] != b[0]:
        return 0
    best = np.zeros((len(a[2]) + 1, len(b[2]) + 1), int)
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_match(x, y))
    return int(best[-1][-1]) + 1


def test_tree_matching():
    a = ["r", 1, [["x", 1, []], ["y", 1, [["z", 1, []]]]]]
    b = ["r", 1, [["w", 1, []], ["y", 1, [["z", 1, []], ["q", 1, []]]]]]
    n, pairs = html_extract.match_children(a, b)
    assert n == 3 and pairs == [(1, 1)]
    merged = html_extract.merge_templates(a, b)
    assert [k[0] for k in merged[2]] == ["x", "w", "y"] and merged[1] == 2 and merged[2][2][1] == 2
    assert html_extract.align(merged, b) == [0, 2, 3, 4, 5]
    rng = random.Random(8)

    def tree(depth, name="r"):
        return [name, 1, [tree(depth - 1, rng.choice("abc")) for _ in range(rng.randint(0, 4))] if depth else []]

    for _ in range(200):
        one, two = tree(3), tree(3)
        n, pairs = html_extract.match_children(one, two)
        assert n == brute_match(one, two)
        assert pairs == sorted(pairs) and all(one[2][i][0] == two[2][j][0] for i, j in pairs)
        assert n == 1 + sum(brute_match(one[2][i], two[2][j]) for i, j in pairs)
        merged = html_extract.merge_templates(one, two)
        assert brute_match(merged, two) == html_extract.prune(two, 0)[1]


# ---- 4 language ------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ba", "lo", "mi"], "bb": ["kr", "zt", "wo"], "cc": ["éç", "ùa", "œu"]}
    rows = []
    for i in range(150):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(30)), lang))
    train = spark.createDataFrame([*rows[:100], (900, None, "aa"), (901, "x", None), (None, "ba", "aa")], "doc_id long, text string, lang string")
    model = langid.fit(train, max_train=90)
    assert sorted(set(model.languages)) == sorted(kinds) and len(model.languages) <= 12
    test = spark.createDataFrame([*rows[100:], (1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (1003, "жжж щщщ жщж", None)], train.schema)
    got = {r.id: r for r in langid.predict(test, model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, lang in rows[100:])
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1003].lang_pred in kinds
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(test, empty).collect()} == {"und"}


# ---- 5 SimHash -------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = 0
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hs) > len(hs):
            bits |= 1 << b
    return bits


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("max_bucket", [4096, 3])
def test_simhash(spark, max_bucket):
    rng = random.Random(2)
    base = [words(rng.randint(1, 120), rng) for _ in range(25)]
    texts = [*EDGE, *base]
    for b in base[:12]:
        w = b.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
    texts += [base[3].upper(), base[3]]
    got = simhash.near_duplicates(docs_of(spark, texts), max_bucket=max_bucket).collect()
    prints = [brute_fingerprint(t) for t in texts]
    want = {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("max_bucket", [4096, 2])
def test_simhash_links_are_complete(spark, max_bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(6):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    links = simhash.fingerprint_links(df, max_bucket)
    assert all(((r.a & (1 << 64) - 1) ^ (r.b & (1 << 64) - 1)).bit_count() <= 4 for r in links.collect())
    got = {r.node: r.component for r in connected_components(links).collect()}
    ids = brute_components(values)
    groups = defaultdict(set)
    for v, c in zip(signed, ids):
        groups[c].add(v)
    for members in groups.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(v, v) for v in signed}) == len(groups)


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1300)}}


# ---- 6 toxicity ------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        sentences = [words(6, rng) + "." for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            sentences[rng.randrange(len(sentences))] = words(2, rng) + f" badword{rng.choice('abcdef')} " + words(2, rng) + "."
        rows.append((i, " ".join(sentences)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "..."), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1000, 1), (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(200, 300)) >= 97
    hit = next(got[i] for i in range(201, 300, 3) if got[i].predicted)
    assert len(hit.sentences) == 1 and "badword" in hit.sentences[0].text
    assert got[1000].score == got[1001].score == got[1002].score == 0.0 and got[1001].sentences == []
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 1e-9 for r in toxicity.score(docs, nothing).collect())


def test_toxicity_noisy_or():
    """Score and gradient against the definition, sentence by sentence."""
    rng = np.random.default_rng(2)
    model = toxicity.ToxicModel({f: float(rng.normal()) for w in ("ab", "cdefgh", "xyz") for f in toxicity.word_features(w)}, -1.0)
    for text in ("ab cdefgh. xyz! ab", "...", "", "zz", "ab ab\nxyz xyz xyz? cdefgh", None):
        clean, some = 1.0, False
        for part in re.split(r"[.!?\n]", text or ""):
            own = re.findall(r"\w+", part)
            if own:
                z = -1.0 + sum(model.weights.get(f, 0.0) for w in own for f in toxicity.word_features(w))
                clean, some = clean * (1 - 1 / (1 + np.exp(-z))), True
        assert abs(model.scorer().score(text) - (1 - clean if some else 0.0)) < 1e-12
    doc, labels, weight = np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    z = rng.normal(size=6)
    gradient, _ = toxicity.noisy_or_gradient(z, doc, labels, weight)
    for i in range(6):
        up, down = z.copy(), z.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (toxicity.noisy_or_gradient(up, doc, labels, weight)[1] - toxicity.noisy_or_gradient(down, doc, labels, weight)[1]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5


def test_toxicity_edge_tables(spark):
    """Repeated ids and rows, clashing columns, a very long text, empty tables."""
    schema = "doc_id long, text string, score string, predicted string"
    rows = [(i, f"{'bad' if i % 2 else 'good'} word{i % 7}. fine", "c", "c") for i in range(60)]
    long = "good word. " * 50_000
    docs = spark.createDataFrame([*rows, *rows[:10], (3, "bad again", "c", "c"), (70, long, "c", "c"), (70, long + "bad bad", "c", "c")], schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    assert sum(map(len, got.values())) == 73 and got[5][0] == got[5][1] and got[5][0] > got[4][0] and got[70][0] != got[70][1]
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs.limit(0), labels).weights == {} and toxicity.fit(docs, labels.where("toxic = 1")).weights == {}
    small = toxicity.fit(docs, labels, max_train=20, max_features=5)
    assert len(small.weights) <= 5


# ---- 7 quality -------------------------------------------------------------


def brute_base(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark):
    good = "\n".join(words(20) + "." for _ in range(8))
    menu = "\n".join("a | b | c | d" for _ in range(5)) + "\n" + words(60) + "."
    junk = " | ".join(words(1) for _ in range(120))
    half = words(60) + "\n" + words(10) + ".\n" + words(2)
    texts = [*EDGE, good, menu, junk, half, good + "\n" + good, "#$ " + words(70) + ". a\u00a0b \x85 c"]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), t
        assert not (r.base_failed and r.kept)
    n = len(EDGE)
    assert got[n].kept and got[n].text == good and got[n].n_lines_failed == 0
    assert got[n + 1].n_lines_failed == 5 and got[n + 1].kept and "|" not in got[n + 1].text
    assert not got[n + 2].kept and not got[n + 3].kept
    assert quality.line_verdict("We use cookies. All rights reserved.") == "boilerplate"


# ---- 8 lines ---------------------------------------------------------------


def brute_lines(rows, ratio=0.1, least=3):
    pages, count = Counter(s for s, _ in rows), Counter()
    for s, t in rows:
        for key in {x.strip(line_dedup.BLANKS) for x in (t or "").split("\n")} - {""}:
            count[s, key] += t is not None
    out = []
    for s, t in rows:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for x in lines if not (k := x.strip(line_dedup.BLANKS)) or not (count[s, k] >= least and count[s, k] / pages[s] > ratio)]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [16 << 20, 0])
def test_line_dedup(spark, broadcast_bytes):
    rows = [("hot", f"Menu \nline {i}\n\nshared {i % 12}\nfoot" if i % 9 else "foot\nfoot") for i in range(60)]
    rows += [("hot", None), ("hot", ""), (None, "Menu\nx"), (None, "Menu\ny"), (None, "Menu"), ("tiny", "Menu\nfoot"), ("tiny", "Menu\nfoot")]
    df = spark.createDataFrame([(i, t, s, 7) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df, broadcast_bytes=broadcast_bytes).collect()}
    assert got == dict(enumerate(brute_lines(rows)))
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0
    plan = line_dedup.drop_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 9 BPE -----------------------------------------------------------------


def spaced_texts(n):
    rng = random.Random(12)
    marks = [" ", " ", " ", "  ", "\n", " \n", "\t", "a", "B1", "né", "'s", ",", ".", "\u00a0", "世", "don't"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_block_words_are_cut_as_the_pattern_does():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow
    import regex

    for texts in (spaced_texts(3000), ["", " ", "  ", " a", "a ", "\n a", "a \n", "a b", None], [" "], []):
        block = bpe.BlockWords(public_tokenizers.PATTERN, pyarrow.array(texts, pyarrow.string()))
        starts = np.cumsum(block.sizes) - block.sizes
        for text, row in zip(texts, block.rows):
            cut = [block.words[block.of_parts[i]].decode() for i in block.gather(row, block.sizes, starts).tolist()]
            assert cut == regex.findall(public_tokenizers.PATTERN, text or "")


def test_bpe_plan_folds_with_higher_order_functions(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = bpe.encode_documents(docs_of(spark, ["a b"]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "array_min" in plan
    empty = bpe.encode_documents(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert empty.collect() == []


def test_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = bpe.load_ranks(path)
    ranks = {p: i for i, p in enumerate(pieces)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [*EDGE, "Hello, world! It's 2024\r\n\t x", "x" * 700, "🙂 émoji <|endoftext|>", " \u00a0 \u2003a", words(200), *spaced_texts(60)]
    got = {r.doc_id: r for r in bpe.encode_documents(docs_of(spark, texts), path, pattern, keep=["lang"], block_bytes=20_000).collect()}
    sums = {r.doc_id: r for r in bpe.encode_documents(docs_of(spark, texts), path, pattern, digest=True).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids and bytes(got[i].decoded) == (t or "").encode() and got[i].n_tokens == len(ids) and got[i].lang == "en"
        assert sums[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    twice = docs_of(spark, ["same text", None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("_block", F.lit("x"))
    assert [(r.doc_id, r.n_tokens) for r in bpe.encode_documents(twice.union(twice), path, pattern).orderBy("n_tokens").collect()] == [(None, 0), (None, 0), (None, 2), (None, 2)]
    with pytest.raises(ValueError, match="clash"):
        bpe.encode_documents(docs_of(spark, texts).withColumn("ids", F.lit(1)), path, pattern, keep=["ids"])
    for word in (b"abcabcabc" * 40, b"z", "ünïcödé".encode() * 50):
        assert bpe.merge_word(word, ranks) == bpe._merge_long_word(word, ranks)
    # the higher-order functions fold to the same ids
    chosen = [w.encode() for w in ("hello", " world", "", "qzxv", "antidisestablishment", "é世", "aaaaaaa")]
    df = spark.createDataFrame([(w,) for w in [*chosen, None]], "word binary")
    folded = {bytes(r.word): r for r in bpe.encode_words(df, path).collect()}
    assert {w: (r.ids, bytes(r.decoded)) for w, r in folded.items()} == {w: (bpe.merge_word(w, ranks) if w else [], w) for w in chosen}


# ---- 10 repeated passages --------------------------------------------------


def passages():
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    base = [text(rng.randrange(0, 900)) for _ in range(30)]
    p, q = text(320), text(215)
    out = base + [a[:300] + b[100:500] for a, b in zip(base, base[1:])]
    out += [text(100) + p + text(80), text(33) + p + text(5), q + text(3), text(70) + q, "ab" * 300, "ab" * 200, "x" * 450]
    # a repeated word between other text, in different surroundings
    out += [text(150) + "Und der " * n + text(180) for n in (0, 20, 31, 60)] + [text(90) + "chlich " * 70 + p[:40], "chlich " * 45 + text(30)]
    out += [None, "", text(200) + p[:199], base[3], base[3]]
    return out + [text(k) + base[7][k : k + 260] + text(50) for k in range(0, 200, 9)]


@pytest.mark.parametrize(
    ("length", "block_bytes", "hot", "range_bytes", "max_cuts"),
    [(200, 8 << 20, 50_000, 4000, 4096), (200, 3000, 1, 40, 3), (120, 5000, 3, 400, 0)],
)
def test_suffix_dedup(spark, tmp_path, length, block_bytes, hot, range_bytes, max_cuts):
    texts = passages()
    df = stored(spark, docs_of(spark, texts).repartition(3), tmp_path)
    got = suffix_dedup.remove_repeats(df, length=length, block_bytes=block_bytes, range_bytes=range_bytes, hot=hot, max_cuts=max_cuts).collect()
    want = brute.remove_repeats(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == dict(enumerate(want))


def test_suffix_ranges_have_no_cap():
    cuts = [b"b", b"m"]
    strings = [bytes([c]) * 30 + bytes([d]) for c in range(97, 123) for d in range(50)]
    places = {s: suffix_dedup.range_of(cuts, 1000, s) for s in strings}
    assert len(set(places.values())) > 900 and all(0 <= p < 3000 for p in places.values())
    # equal strings meet, and ranges follow the sorted order
    assert all(p == suffix_dedup.range_of(cuts, 1000, bytes(bytearray(s))) for s, p in places.items())
    assert [suffix_dedup.range_of(cuts, 1, s) for s in sorted(strings)] == sorted(suffix_dedup.range_of(cuts, 1, s) for s in strings)


def test_suffix_dedup_of_nothing(spark, tmp_path):
    df = stored(spark, docs_of(spark, []), tmp_path)
    assert suffix_dedup.remove_repeats(df).count() == 0


def test_loser_tree():
    rng = random.Random(6)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))}) for _ in range(7)]
    coded = [suffix_dedup.front_code(r, [1] * len(r)) for r in runs]
    assert [[s for s, _, _ in suffix_dedup.read_run(c)] for c in coded] == runs
    merged = list(suffix_dedup.LoserTree([suffix_dedup.read_run(c) for c in coded]))
    assert [s for s, *_ in merged] == sorted(s for r in runs for s in r)
    for (a, *_), (b, shared, *_) in zip(merged, merged[1:]):
        assert shared == suffix_dedup.common_prefix(a, b, 0)
    assert list(suffix_dedup.LoserTree([])) == []


def test_shingles_of_few_words():
    assert len(shingle_hashes([], 3)) == 0 and len(shingle_hashes([b"a", b"b"], 3)) == 1 and len(shingle_hashes([b"a"] * 5, 3)) == 3


def test_workers_free_memory(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "free_memory", lambda: freed.append(1))

    def doubled(batches):
        for batch in batches:
            yield batch * 2

    assert list(common.lean(doubled)(iter([1, 2]))) == [2, 4] and freed == [1]
    assert list(common.lean(doubled)(iter([]))) == [] and freed == [1, 1]
    with pytest.raises(TypeError):
        list(common.lean(doubled)(iter([None])))
    assert freed == [1, 1, 1]
    monkeypatch.undo()
    common.free_memory()
