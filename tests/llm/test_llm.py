import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pricelens.llm import (
    chat_format, components, decontamination, language_id, license_scan, minhash_dedup, quality_rules, source_mix, substring_dedup,
    queries, suffix_dedup, url_filter,
)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def covered(n, starts, size):
    marks = [False] * n
    for s in starts:
        marks[s : s + size] = [True] * size
    return marks


def brute_windows(docs, split, join, size):
    parts = [split(r["text"] or "") for r in docs]
    seen = Counter(tuple(p[i : i + size]) for p in parts for i in range(len(p) - size + 1))
    out = []
    for r, p in zip(docs, parts):
        gone = covered(len(p), [i for i in range(len(p) - size + 1) if seen[tuple(p[i : i + size])] > 1], size)
        kept = [x for x, g in zip(p, gone) if not g]
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r["doc_id"], len(p), sum(gone), runs, hashlib.sha256(join(kept)).hexdigest()))
    return out


def random_docs(spark, n=60):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    stock = [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 200)))
        if i % 3 == 0:
            cut, piece = rng.randint(0, len(text)), rng.choice(stock)
            text = text[:cut] + piece[rng.randint(0, 60) :] + text[cut:]
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("make", [lambda s, d: d, lambda s, d: random_docs(s)])
def test_substring_dedup(spark, docs, make):
    df = make(spark, docs)
    want = brute_windows(df.collect(), lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda k: " ".join(k).encode(), 35)
    got = rows_of(substring_dedup.digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted([(a, b, c, e) for a, b, c, _, e in want], key=repr)


def test_substring_lengths(spark):
    df = random_docs(spark)
    got = substring_dedup.digest(df, 20).collect()
    want = brute_windows(df.collect(), str.split, lambda k: " ".join(k).encode(), 20)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == sorted((a, c) for a, _, c, _, _ in want)
    assert substring_dedup.lengths_to(35) == [18, 35]


def test_strip_repeats(docs):
    out = substring_dedup.strip_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[4]["text"] == "start end" and texts[4]["n_chars"] == 9 and texts[4]["score"] == 7
    assert texts[8]["text"] == "one two" and texts[6]["text"] is None and 1 not in texts


@pytest.mark.parametrize("make, block", [(lambda s, d: d, 20_000), (lambda s, d: random_docs(s), 20_000), (lambda s, d: random_docs(s), 1)])
def test_suffix_dedup(spark, docs, make, block, monkeypatch):
    df = make(spark, docs)
    real = suffix_dedup.repeated_strings
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda d, w: real(d, w, block))
    want = brute_windows(df.collect(), lambda t: list(t.encode()), bytes, 200)
    assert rows_of(suffix_dedup.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_repeated_in_columns():
    rng = random.Random(5)
    for _ in range(400):
        groups, leads, clips = [], [], []
        for g in range(rng.randint(1, 3)):
            held = set()
            for _ in range(rng.randint(3, 10)):
                lead, tail = rng.randint(0, 5), rng.randint(2, 6)
                held.add((lead, "".join(rng.choice("ab") for _ in range(lead)) + "a" + "".join(rng.choice("ab") for _ in range(tail))))
            for lead, clip in sorted(held, key=lambda _: rng.random()):
                if len(clip) >= 3:
                    groups.append(g), leads.append(lead), clips.append(clip.encode())
        seen = Counter((g, o - lead, c[o : o + 3]) for g, lead, c in zip(groups, leads, clips) for o in range(len(c) - 2))
        want = [[seen[g, o - lead, c[o : o + 3]] > 1 for o in range(len(c) - 2)] for g, lead, c in zip(groups, leads, clips)]
        found = suffix_dedup.repeated_in_columns(np.array(groups), np.array(leads), clips, 3)
        assert [list(f[: len(w)]) for f, w in zip(found, want)] == want


def brute_components(rows, percent):
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def test_minhash_dedup(spark, docs):
    rng = random.Random(1)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 14]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(minhash_dedup.near_copies(df), *names) == sorted(brute_components(rows, 85), key=repr)


def test_minhash_blocks_and_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_CLASSES", 1)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_copies(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (8, 8, True), (9, 8, False), (7, 7, True)} <= got
    left = minhash_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 4, 6, 7, 8, 10, None, None, 12, 14, 16, 17])


def test_near_copy_stage_from_80_percent(spark):
    rng = random.Random(9)
    rows = []
    for i in range(12):
        words = [f"d{i}x{k}" for k in range(150)]
        rows.append((2 * i, " ".join(words)))
        for k in rng.sample(range(10, 140, 10), 2 + i % 3):  # similarity 0.87, 0.81 and 0.77
            words[k] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [i for i, _, _, kept in brute_components(rows, 80) if kept]
    assert len(want) == 16
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect()) == want


def odd_ids(spark, text_id):
    """Repeated ids with unrelated texts, copies under several ids, repeated rows, odd column names."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = texts["a"].replace("a30 ", "zz ")
    rows = [(1, texts["a"]), (1, texts["c"]), (5, texts["b"]), (2, texts["d"]), (2, texts["e"]), (3, texts["e"]), (4, texts["d"]), (7, near), (0, texts["f"]), (0, texts["f"])]
    rows += [(8, texts["f"]), (9, None), (9, ""), (None, texts["g"]), (None, texts["g"]), (10, " . "), (11, "a b"), (12, "A b")]
    rows = [(None if i is None else text_id(i), t, "en", "s", k, k, k, k) for k, (i, t) in enumerate(rows)]
    kind = "string" if isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, `a.b` int, Score int, Slot int, text_only int").repartition(4)


@pytest.mark.parametrize("text_id", [int, lambda i: f"d{i:02}"])
def test_keep_one_loses_no_text(spark, text_id):
    df = odd_ids(spark, text_id)
    rows = df.collect()
    sets, parent = {}, {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r["text"]))
        sets[r["a.b"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and r["doc_id"] is not None else set()
        parent[r["a.b"]] = r["a.b"]

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for r in rows:
        groups.setdefault(root(r["a.b"]), []).append(r)
    got = {(r["doc_id"], r["a.b"]): r for r in minhash_dedup.keep_one(df, 80).collect()}
    assert len(got) == len(groups)
    for members in groups.values():
        kept = [r for r in members if (r["doc_id"], r["a.b"]) in got]
        assert len(kept) == 1 and got[kept[0]["doc_id"], kept[0]["a.b"]] == kept[0]
        assert kept[0]["doc_id"] == min((r["doc_id"] for r in members), key=lambda i: (i is not None, i))
    named = {}
    for r in minhash_dedup.near_copies(df, 80).collect():
        named.setdefault((r["doc_id"], r["n_shingles"]), set()).add((r["component_id"], r["kept"]))
    least = lambda i: min(r["doc_id"] for r in groups[root(i)])
    want = {}
    for r in rows:
        own = None if r["doc_id"] is None else least(r["a.b"])
        n = len({tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(r["text"]))] if w for k in range(max(1, len(w) - 4))})
        want.setdefault((r["doc_id"], n), set()).add((own, own is None or own == r["doc_id"]))
    assert named == want


def test_stages_carry_columns_of_any_name(spark):
    df = odd_ids(spark, int)
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    key = lambda out: Counter(tuple(r[c] for c in df.columns if c != "text") for r in out.collect())
    whole = key(df)
    kept = language_id.keep_known(df, 0.0)
    assert kept.columns == df.columns and key(kept) <= whole and len(key(kept)) > 10
    assert key(decontamination.clean(df, bench)) == whole
    stripped = substring_dedup.strip_repeats(df, 61)
    assert stripped.columns == df.columns and key(stripped) <= whole
    mixed = source_mix.mix(df)
    assert mixed.columns == [*[c for c in df.columns if c != "Slot"], "slot", "place", "in_mix"] and mixed.count() == df.count()


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """run() on a small corpus: copies, a shared passage, a benchmark passage and foreign letters; values included."""
    rng = random.Random(21)
    pools = {"en": "the of and to in is that it".split(), "de": "der die und das ist von mit im".split()}
    word = lambda lang: rng.choice(pools[lang]) if rng.random() < 0.4 else f"{'th' if lang == 'en' else 'sch'}{rng.randrange(10**5)}er"
    rows = [(i, " ".join(word(lang) for _ in range(50)), lang, "ab"[i % 3 > 0]) for i in range(60) for lang in ("en" if i % 2 else "de",)]
    rows += [(100 + i, rows[i][1], rows[i][2], "a") for i in range(5)]  # copies
    rows += [(110, rows[7][1].rsplit(" ", 3)[0] + " one more end", "en", "b")]  # a near copy
    passage = " ".join(word("en") for _ in range(45))
    rows += [(120 + i, f"{' '.join(word('en') for _ in range(40))} {passage} {' '.join(word('en') for _ in range(40))}", "en", "a") for i in range(3)]
    item = " ".join(word("en") for _ in range(14))
    rows += [(130, f"{' '.join(word('en') for _ in range(30))} {item}", "en", "b"), (140, None, "en", "a"), (141, "123 456", "en", "a"), (142, "", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    texts = {i: t for i, t, *_ in rows}
    with_words = [(i, t) for i, t, *_ in rows if i not in (140, 141, 142)]
    alone = {i for i, _, _, kept in brute_components(with_words, 80) if kept}
    assert alone == set(texts) - {100, 101, 102, 103, 104, 110, 140, 141, 142}
    assert set(got) == alone - {130}
    for i, r in got.items():
        want = " ".join(texts[i].split()[:40] + texts[i].split()[-40:]) if i in (120, 121, 122) else texts[i]
        assert " ".join(r["text"].split()) == want
        assert (r["lang"], r["source"]) == next((lang, s) for j, _, lang, s in rows if j == i)
    assert len({r["place"] for r in got.values()}) == len(got)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {60: 50}


def test_decontamination(spark, docs):
    items = [(1, " ".join(f"P{i}" for i in range(5, 25))), (2, "one two"), (3, None), (11, "..."), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 zz"), (5, "words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for i, t in items:
        w = re.findall(pattern, ascii_lower(t))
        n = min(10, len(w))
        windows += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    want = []
    for r in docs.collect():
        w = re.findall(pattern, ascii_lower(r["text"]))
        hit, found = [False] * len(w), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    found.add(str(i))
                    hit[k : k + len(g)] = [True] * len(g)
        want.append((r["doc_id"], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontamination.contamination(docs, bench), *names) == sorted(want, key=repr)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, *_, bad in want if not bad}
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "ho"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "ho"), (3, 2, "user", "x"),
        (4, 0, None, None), (5, 0, None, None), (6, 0, "user", ""), (None, 0, "user", "hi"), (7, None, "user", "a <|im_end|> b"), (7, 1, "bot", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat_format.render(df).collect()}
    assert set(got) == {3, 4, 6, 7}
    assert got[3][1].count("<|im_start|>") == 3 and got[7] == (2, "<|im_start|>user\na <| im_end |> b<|im_end|>\n<|im_start|>bot\ny<|im_end|>")
    assert chat_format.render(df.limit(0)).count() == 0


def test_source_mix(spark, docs):
    big = spark.createDataFrame([(i, "abcdd"[i % 5]) for i in range(1500)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 4)], "source string, weight long")
    rows = sorted(source_mix.mix(big, weights).collect(), key=lambda r: r["place"])
    assert len({r["place"] for r in rows}) == 1500
    share, count, last = {"a": 5 / 13, "b": 3 / 13, "c": 1 / 13, "d": 4 / 13}, Counter(), max(r["slot"] for r in rows if r["in_mix"])
    by_slot = {r["slot"]: r["source"] for r in rows}
    for t in range(last + 1):
        count[by_slot[t]] += 1
        assert all(abs(count[s] - w * (t + 1)) < 1 for s, w in share.items())
    out = source_mix.mix(docs)
    assert out.columns == [*docs.columns, "slot", "place", "in_mix"] and out.count() == docs.count()


def test_source_mix_plans_anew_when_a_source_runs_out(spark):
    """Slot by slot against a plain walk with given weights, and against the SQL with default ones."""
    sizes = {"a": 61, "b": 3, "c": 8, None: 27, "d": 160}
    weights = {"a": 5, "b": 2, "c": 3, None: 1, "d": 4}
    ids = [s for s, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, source string")
    left, t, want, first = {s: -(-n // 4) for s, n in sizes.items()}, 0, [], None
    while any(left.values()):
        names = sorted((s for s in left if left[s]), key=lambda s: s or "")
        total, taken, start = sum(weights[s] for s in names), Counter(), t
        while True:
            _, _, s = min((-(-(taken[s] + 1) * total // weights[s]), i, s) for i, s in enumerate(names) if taken[s] * total // weights[s] <= t - start)
            if not left[s]:
                break
            want.append(s)
            taken[s], left[s], t = taken[s] + 1, left[s] - 1, t + 1
        first = t if first is None else first
    given = spark.createDataFrame([(s, w) for s, w in weights.items() if s], "source string, weight long")  # null: 1
    rows = source_mix.mix(df, given).collect()
    by_slot = {r["slot"]: r["source"] for r in rows}
    assert [by_slot[i] for i in range(len(by_slot))] == want and {r["doc_id"] for r in rows} == set(range(len(ids)))
    assert all(r["in_mix"] == (r["slot"] < first) for r in rows) and 0 < first < len(want)
    assert len({r["place"] for r in rows}) == len(rows) and max(Counter(r["slot"] for r in rows).values()) == 4

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, s] for i, s in enumerate(ids)])
    columns = ["doc_id", "source", "slot", "place", "in_mix"]
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({source_mix.ORACLE})").fetchall()) == sorted(tuple(r[c] for c in columns) for r in source_mix.mix(df).collect())
    assert source_mix.mix(df.limit(0)).count() == 0


def test_clashing_columns(spark, docs, tmp_path):
    names = ["weight", "slots", "length", "slot", "place", "in_mix", "s1", "offset"]
    own = docs.select("*", *[docs["score"].cast("string").alias(c) for c in names])
    out = source_mix.mix(own)
    assert out.columns == [*docs.columns, "weight", "slots", "length", "s1", "offset", "slot", "place", "in_mix"]
    out.write.parquet(str(tmp_path / "mix"))
    assert {tuple(r[c] for c in ("weight", "slots", "length", "s1", "offset", "row_hash")) for r in spark.read.parquet(str(tmp_path / "mix")).collect()} == {("7",) * 5 + ("mine",)}
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    kept = decontamination.clean(docs, bench)
    assert kept.schema.names == docs.columns and rows_of(kept, *docs.columns) == rows_of(docs, *docs.columns)


def test_language_id(spark, docs):
    pools = {"en": "the of and to in is".split(), "de": "der die und das ist von".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(pools[lang]) for _ in range(30)), lang) for i in range(200) for lang in ("en" if i % 2 else "de",)]
    rows += [(300, None, "en"), (301, "123 !?", "en"), (302, "unders thend", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[302]["lang_pred"] == "en" and 0 <= got[302]["score"] <= 1
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and not {6, 7, 10} & {r["doc_id"] for r in kept.collect()}


def test_quality_rules(spark, docs):
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = sum(covered(len(w), [k for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1], 5))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality_rules.judge(docs)
    assert rows_of(out, *names) == sorted(want, key=repr)
    assert out.where("base_failed and kept").count() == 0
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)), "en", "a") for i in range(100)]
    rows += [(200 + i, re.sub(r"\b ", "### ", t), "en", "a") for i, t, *_ in rows[:10]]
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(v == (i < 200) for i, v in verdict.items())


def test_quality_rules_reject_sparse_symbols(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) for _ in range(120)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    rows += [(500 + i, t.replace(" ", " | ", 14 + i), "en", "a") for i, t in enumerate(texts[:20])]  # 5 to 11 symbols per 100
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(verdict[i] for i in range(120)) == 120 and not any(v for i, v in verdict.items() if i >= 500)


def test_mcd_is_settled(spark):
    rng = np.random.default_rng(2)
    far = rng.normal(size=(300, 4)) * 2 + (np.arange(300)[:, None] % 3 == 0) * rng.normal(4, 3, size=(300, 4))
    rows = spark.createDataFrame([("en", "=a", *map(float, x)) for x in far], "lang string, group string, f1 double, f2 double, f3 double, f4 double")
    found = quality_rules.mcd(rows)
    joined = rows.join(found, ["lang", "group"])
    again = quality_rules._concentrate(joined.select(*rows.columns, quality_rules._distance(joined).alias("d")), quality_rules.F.col("d"))
    assert again.first()["det"] >= found.first()["det"] - 1e-5


def test_mcd_moments(spark):
    rows = [("en", "=a", float(x), float(y), 0.0, 1.0) for x, y in np.random.default_rng(0).normal(size=(200, 2))]
    got = quality_rules.mcd(spark.createDataFrame(rows, "lang string, group string, f1 double, f2 double, f3 double, f4 double")).first()
    assert abs(got["m0"]) < 0.3 and abs(got["m1"]) < 0.3 and got["l33"] == pytest.approx(0.6) and 0.7 < got["l00"] < 1.5


def test_license_scan(docs):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    r = got[17]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (8, 2, 2, 5, "mit") and r["labels"] == "mit"
    assert (got[6]["n_words"], got[6]["first_word"], got[6]["labels"], got[6]["score"]) == (0, None, "", 0.0)


def test_license_query_counts_the_phrases_of_its_contract(spark, tmp_path):
    """Base columns by plain search; ``the mit license`` without ``under`` is no base phrase."""
    rng = random.Random(7)
    texts = ["The MIT License", "under THE mit-license, under the under the mit\nlicense", "cc by ncx cc by nc", "Apache License, Version 2.0", "åunder the mit license", None, ""]
    stock = ["Under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é"]
    texts += [rng.choice([" ", "-", ". "]).join(rng.choices(stock, k=rng.randint(0, 12))) for _ in range(100)]
    texts += [f"{a} {p} {b}" for (p, _), a, b in zip(PHRASES * 10, texts[7:], texts[40:])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at = sorted((k, label) for p, label in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split())
        want.append((i, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = queries.QUERIES["op7_license_scan"](spark, str(tmp_path))
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r["doc_id"]: r for r in got.collect()}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in labels.values())


PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
NOTICES = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ("This program is free software you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3", "agpl-3"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2", "lgpl-2"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("Permission is hereby granted, free of charge, to any individual person obtaining a copy of this software and associated documentation files", "mit"),
    ("This work is licensed under the terms of the GNU General Public License version 3", "gpl-3"),
    ("Redistribution and use in source and binary form, with or without modification, are permitted", "bsd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("nothing of the kind is said in this text about any license or its version", ""),
]


def test_license_scan_tells_families_apart(spark):
    files = [f"Some words before. {text}. And the words after it." for text, _ in NOTICES] + [" x y z ".join(t for t, _ in NOTICES[:6:5])]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)] + [(100, None), (101, "q " * 200_000 + files[0])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [label for _, label in NOTICES]
    assert got[len(NOTICES)] == "gpl-3,lgpl-2.1" and got[100] == "" and got[101] == "gpl-3"


def brute_common(template, words, idf):
    """(weight, first, last) of the heaviest common subsequence, over whole tables of both."""
    best = [[(0.0, 0, 0)] * (len(template) + 1) for _ in range(len(words) + 1)]
    for i, (place, word) in enumerate(words):
        for o, w in enumerate(template):
            options = [best[i][o + 1], best[i + 1][o]]
            if w == word:
                weight, first, _ = best[i][o]
                options.append((weight + idf[w], first if weight else place, place))
            best[i + 1][o + 1] = max(options, key=lambda x: x[0])
    return best[-1][-1]


def test_license_scan_against_every_alignment(spark):
    """Every start of every template, files with inserted, missing and changed words: the same labels."""
    texts = [text for _, text, _ in license_scan.TEMPLATES]
    rng = random.Random(6)
    stock = sorted({w for t in texts for w in t.split()})
    files = list(texts)
    for _ in range(60):
        words = []
        for t in rng.sample(texts, rng.randint(1, 3)):
            for w in t.split():
                chance = rng.random()
                words += [] if chance < 0.06 else [rng.choice(stock)] if chance < 0.12 else [w, rng.choice(stock)] if chance < 0.18 else [w]
            words += rng.choices(stock, k=rng.randint(0, 6))
        files.append(" ".join(words))
    held = Counter(w for f in files for w in set(f.split()))
    idf = {w: np.log((len(files) + 1) / (held[w] + 1)) + 0.01 for w in stock}
    want = []
    for i, f in enumerate(files):
        words, labels, found = f.split(), {label for phrase, label in license_scan.BASE if f" {phrase} " in f" {f} "}, []
        for label, text, keys in license_scan.TEMPLATES:
            parts = text.split()
            whole = sum(idf[w] for w in parts)
            for start in range(len(words)):
                stretch = list(enumerate(words))[start : start + len(parts) + license_scan.GAP]
                if words[start] not in parts or not all(f" {key} " in f" {' '.join(w for _, w in stretch)} " for key in keys):
                    continue
                weight, first, last = brute_common(parts, [x for x in stretch if x[1] in parts], idf)
                if weight >= license_scan.COVERAGE * whole:
                    found.append((label, weight / whole, weight, first, last))
        labels |= {label for label, _ in license_scan.settled(found)}
        want.append((i, ",".join(sorted(labels))))
    assert len({x for _, x in want}) > 15
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, text string").repartition(4)
    assert rows_of(license_scan.scan(df), "doc_id", "labels") == sorted(want, key=repr)


def test_url_filter(spark):
    urls = ["http://A.example.com/en/1", "https://www.example.com/en/2?x", "http://x.net/es/3#y", "http://x.net/en/4", "no scheme", None, "http://com/a", "s://x.org"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2] == ("x.net", "/es/3", "net/es/", "block") and got[4] == ("", "", None, "allow") == got[5]
    assert got[6] == ("com", "/a", "com/", "allow") and got[7][:3] == ("x.org", "", None)


def test_url_filter_blocks_by_template_host_and_domain(spark):
    blocked = [f"http://x.net/es/{i}" for i in range(30)] + [f"http://x.net/fr/{i}" for i in range(20)]
    open_pages = ["http://x.net/en/1", "http://x.net/", "http://y.net/en/1", "http://a.y.net/en/1/2/3/4/5/6", "http://z.org/es/1"]
    for more in ([f"http://b.com/{i}" for i in range(300)], []):  # a low and a high rate of all labelled pages
        df = spark.createDataFrame(list(enumerate(blocked + more + open_pages)), "page_id long, url string")
        got = {r["url"]: r for r in url_filter.judge(df).join(df, "page_id").collect()}
        assert [got[u]["verdict"] for u in open_pages] == ["block"] * 4 + ["allow"]
        base = 50 / (50 + len(more))
        net = (50 + 4 * base) / 54
        host = (50 + 4 * net) / 54
        assert got["http://z.org/es/1"]["purity"] == pytest.approx(base)
        assert got["http://x.net/"]["purity"] == pytest.approx(host) and got["http://y.net/en/1"]["purity"] == pytest.approx(net)


def test_empty_tables(none):
    for apply in (substring_dedup.digest, suffix_dedup.digest, minhash_dedup.near_copies, language_id.identify, license_scan.scan, quality_rules.judge, source_mix.mix):
        assert apply(none).count() == 0
    assert minhash_dedup.keep_one(none).count() == substring_dedup.strip_repeats(none).count() == language_id.keep_known(none).count() == 0
    assert url_filter.judge(none.selectExpr("doc_id AS page_id", "text AS url")).count() == 0
