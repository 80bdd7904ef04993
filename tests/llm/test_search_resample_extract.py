"""Lexical search, importance resampling and HTML extraction against brute force and their SQL."""

import hashlib
import os
import random
import re
from collections import Counter
from math import floor, log
from zlib import crc32

import pytest

from catalogue.compare import oracle_rows, rows_of
from pricelens.llm import html_extraction, importance_resampling, lexical_search, queries

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def dumped(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_importance_resampling", "op13_html_extraction", "op1_decontamination", "op4_chat_format", "op5_source_mix"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_its_statement(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names, _, rows = oracle_rows(SF, queries.ORACLES[name])
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rows)


# ---- search -------------------------------------------------------------------
def brute_search(docs, items, top):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, length = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in texts:
            m = 25 + (75 * c.total() * n_docs) // length
            score = sum(n * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(120)]
    weights = [1 / (1 + i) for i in range(120)]
    docs = [(i, " ".join(rng.choices(pool, weights, k=rng.randint(1, 80)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)]  # copies, so that many tie
    docs += [(500, None), (501, ""), (502, "..."), (503, "W3 " * 5000), (None, docs[3][1]), (505, docs[4][1]), (505, docs[4][1]), (506, "É é ñandú W1")]
    items = [(i, " ".join(rng.choices(pool, k=12))) for i in range(15)]
    items += [(20, docs[7][1]), (20, docs[7][1]), (21, None), (22, "nowhere"), (None, "w3 w3 w5"), (23, "w1"), (23, "w2 é É"), (24, "w0 " * 9)]
    return docs, items


@pytest.mark.parametrize("probes, pairs", [(20, 20_000), (1, 30)])
def test_search_is_exact(spark, monkeypatch, probes, pairs):
    monkeypatch.setattr(lexical_search, "PROBES", probes)
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "GATHER", 50)
    docs, items = search_rows()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for top in (10, 3):
        got = dumped(lexical_search.search(df, asked, top), "item_id", "rank", "doc_id", "score")
        assert got == brute_search(docs, items, top)


def test_search_with_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("c", "four")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in lexical_search.search(docs, items).collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.where("doc_id = 'z'").unionByName(docs.selectExpr("doc_id", "'..' AS text")), items).count() == 0


# ---- resampling ---------------------------------------------------------------
def brute_resample(docs, target, percent=25):
    def features(text):
        w = terms(text)
        return [crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(b for _, text in docs for b in features(text)), Counter(b for text in target for b in features(text))
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(floor(1000 * log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None, len(terms(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resample(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Ab", "cd", "éF", "g-h", "i1"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 60)))) for i in range(240)]
    docs += [(300, None), (301, ""), (None, docs[1][1]), (302, "x " * 30000), (5, docs[5][1]), (5, docs[9][1]), (303, "one two")]
    target = ["Ab1 cd2 éf3 ab4", None, "i11 g h7"]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, weight int").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    names = ("doc_id", "n_features", "weight", "score", "rank")
    want = brute_resample(docs, target)
    assert dumped(importance_resampling.resample(df, wanted), *names) == want
    assert dumped(importance_resampling.resample(df, wanted.limit(0)), *names) == brute_resample(docs, [])
    drawn = importance_resampling.draw(df, wanted)
    assert drawn.columns == df.columns and Counter(r["doc_id"] for r in drawn.collect()) == Counter(x[0] for x in want if x[4] is not None)
    assert importance_resampling.resample(df.limit(0), wanted).count() == importance_resampling.draw(df.limit(0), wanted).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_in_pieces(longest):
    text = " ".join(f"wórd{i % 7},X{i}" for i in range(60))
    w = [x.encode() for x in terms(text)]
    want = Counter(crc32(b" ".join(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    for piece in (1, 5, 40, 10_000):
        parts = list(importance_resampling.runs(text.encode(), longest, piece))
        assert sum(n for n, _ in parts) == len(w) and Counter(c for _, found in parts for c in found) == want


def test_ranks_of_ties(spark):
    rows = [(i, 20 + i % 3, 5, 100, 700 * (i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    got = {r["rank"]: r["doc_id"] for r in importance_resampling.ranked(df, 60).collect() if r["rank"]}
    want = sorted(rows, key=lambda r: (-r[4], r[0]))[:240]
    assert got == {k + 1: r[0] for k, r in enumerate(want)}


# ---- extraction ---------------------------------------------------------------
P1 = "The committee met on Tuesday, and after a long debate, it agreed to the plan. Members said that the cost, though high, was fair."
P2 = "A second reading follows in May; until then, letters are welcome from all residents of the town."
LAYOUTS = {
    "article": (f"<body><nav><a>Home.</a></nav><div class='ad'>Buy this now, it is cheap.</div><article><h1>T &amp; U</h1><p><b>{P1}<br><p>{P2}</article><footer>&copy; us</footer>", f"T & U\n{P1}\n{P2}"),
    "named divs": (
        f'<div id="page" class="layout with-sidebar"><div class="header"><a href="/">Home</a> Town news</div><div id="content"><h1>Plan agreed</h1><p>{P1}</p><p>{P2}</p></div>'
        f'<div class="sidebar"><h3>More</h3><ul><li><a href="#">Other story, with a long title.</a></li></ul><p>{P2}</p></div><div id="comments"><p>{P1}</p></div>'
        '<div class="footer">All rights reserved, 2020.</div></div>', f"Plan agreed\n{P1}\n{P2}",
    ),
    "header in article": (
        f"<header><h1>Site</h1></header><main class='has-sidebar'><article><header><h1>Title</h1><p>By me</p></header><p>{P1}<table><tr><td>One.<td>2</table><aside>Note.</aside>"
        f"<form><label>Mail</label></form></article><section class='comments'><article><p>{P2}</p></article></section></main>", f"Title\n{P1}\nOne.\n2",
    ),
    "no names": (
        f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><div><h2>Head</h2><p>{P1}</p><p>Short line.</p><p>{P2}</p></div></div><div>Terms | Privacy</div>",
        f"Head\n{P1}\nShort line.\n{P2}",
    ),
    "notice": (f'<div class="cookie-notice"><p>{P2}</p></div><article><h1>T</h1><p>{P1}</p></article>', f"T\n{P1}"),
    "odd markup": ('<p>a\n  b<!-- c --> d<br>e &eacute;&nosuch;</p><script>if (a<b) "</p>"</script><p hidden>no</p><p>x<span style="display: none">gone</span>y</p>', "a b d e é&nosuch;\nxy"),
    "no tags": ("just text & more &lt;b&gt; a < b", "just text & more <b> a < b"),
    "open comment": ("<p>one <!-- never closed <p>two", "one"),
    "nothing": ("<p></p><div> </div>", ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    html, want = LAYOUTS[name]
    assert html_extraction.main_text(html) == want


def test_extract(spark):
    long = "<article>" + f"<p>{P1}</p>" * 20_000 + "</article>"
    rows = [(1, "u", long, "x", 0), (2, None, None, "x", 0), (2, None, "", "x", 0), (None, "v", f"<p>{P1}", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    want = [(1, "u", "\n".join([P1] * 20_000)), (2, None, ""), (2, None, ""), (None, "v", P1)]
    got = html_extraction.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert dumped(got, *got.columns) == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert html_extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "a, b. " * 20_000, "<div>a. " * 20_000, '<b x="' * 20_000, "<!-- " * 50_000, "<" * 100_000, "<p>" * 50_000, "<li><section>" * 20_000])
def test_hostile_pages_end(html):
    assert isinstance(html_extraction.main_text(html), str)
