"""Licence notices by a positional index of rare words.

The index holds where each word stands in each licence template. A file is looked up by the rarest
words of each template (highest inverse document frequency over all documents), which together weigh more than what a notice may
lack. Their places in the file are intersected by position: only where enough of that weight stands within a template's length and ``GAP``
words can the template be. Such stretches are aligned word by word in order, so inserted, missing and changed words cost only their own
weight; the weight in common is the coverage. A template counts with a coverage of ``COVERAGE`` and all its key phrases, word for word,
inside the stretch: they tell versions and families apart. Where notices of several labels cover the same words, the one with the most weight
in common has them.
Templates whose words, all taken, are too light in the file are left out before any position is read.

Defined cases: null text is empty; no label is an empty string; repeated rows are rows; ties in
rarity go by word, ties in weight by label; very long texts are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Look-up words that a template has at least, the share of its weight that has to match, and words that may be inserted.
RAREST, COVERAGE, GAP = 6, 0.7, 6

# The phrases that count by themselves, by default and in the query, and notices with their key phrases.
CONTRACT_BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE = (("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
LATER = "as published by the free software foundation either version"
COMMONS = "this work is licensed under a creative commons"
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("is hereby granted", "for any purpose")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", f"this program {FREE} general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", f"this program {FREE} general public license {LATER} 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", f"this program {FREE} general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2", f"this program {FREE} general public license {LATER} 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl-2", f"this library {FREE} lesser general public license version 2", ("gnu lesser general public license", "version 2")),
    ("lgpl-2.1", f"this library {FREE} lesser general public license version 2 1", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-2.1", f"this library {FREE} lesser general public license {LATER} 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3", f"this library {FREE} lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("lgpl-3", f"this library {FREE} lesser general public license {LATER} 3 of the license", ("gnu lesser general public license", "version 3")),
    ("agpl-3", f"this program {FREE} affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("agpl-3", f"this program {FREE} affero general public license {LATER} 3 of the license", ("gnu affero general public license", "version 3")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", f"{COMMONS} attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", f"{COMMONS} attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", f"{COMMONS} attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-nc-sa", f"{COMMONS} attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",)),
    ("cc-by-nd", f"{COMMONS} attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc-by-nc-nd", f"{COMMONS} attribution noncommercial noderivatives 4 0 international license", ("attribution noncommercial noderivatives",)),
)


def _words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def _places(words: list[bytes], phrase: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
    return [i for i in where.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]


def _vocabulary() -> set[bytes]:
    return {w for _, text, _ in TEMPLATES for w in text.encode().split()}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wanted = _vocabulary()
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            counts.update(wanted.intersection(_words(text.as_py())))
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def in_common(template: list[bytes], stretch: list[tuple[int, bytes]], idf: dict[bytes, float]) -> tuple[float, int, int]:
    """Greatest weight that a template and (place, word) pairs have in common in order, and the first and last place of it."""
    rows: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(template) + 1)
    for place, word in stretch:
        last = rows[0]
        for o, w in enumerate(template):
            above = rows[o + 1]
            if w == word:
                weight, first, _ = last
                taken = (weight + idf[w], first if weight else place, place)
                if taken[0] > above[0]:
                    rows[o + 1] = taken
            if rows[o][0] > rows[o + 1][0]:
                rows[o + 1] = rows[o]
            last = above
    return rows[-1]


def settled(found: list[tuple[str, float, float, int, int]]) -> list[tuple[str, float]]:
    """(label, coverage) of those of (label, coverage, weight, first, last) that no heavier one of another label overlaps by half."""
    kept: list[tuple[str, float, float, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[2], f[0], f[3], -f[1])):
        if all(f[0] == k[0] or 2 * (min(f[4], k[4]) - max(f[3], k[3]) + 1) < min(f[4] - f[3], k[4] - k[3]) + 1 for k in kept):
            kept.append(f)
    return [(label, cover) for label, cover, *_ in kept]


def _scan(idf: dict[bytes, float], phrases: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(p.encode().split(), label) for p, label in phrases]
        templates = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in TEMPLATES]
        weights = [sum(idf[w] for w in words) for _, words, _ in templates]
        postings = {w for _, words, _ in templates for w in words}
        ends = {p[-1] for p, _ in base}
        lookup: list[frozenset[bytes]] = []
        least = []
        for t, (_, words, _) in enumerate(templates):
            held, lacking, chosen = 0.0, (1 - COVERAGE) * weights[t], []
            for n, w in enumerate(sorted(set(words), key=lambda w: (-idf[w], w))):
                if n >= RAREST and held > lacking:
                    break
                chosen.append(w)
                held += idf[w] * words.count(w)
            lookup.append(frozenset(chosen))
            least.append(held - lacking - 1e-9)

        def aligned(words: list[bytes], present: set[bytes]) -> list[tuple[str, float]]:
            able = [t for t, (_, text, _) in enumerate(templates) if sum(idf[w] for w in text if w in present) >= COVERAGE * weights[t]]
            if not able:
                return []
            known = [(i, w) for i, w in enumerate(words) if w in present]
            found = []
            for t in able:
                label, text, keys = templates[t]
                mine, rare = set(text), lookup[t]
                at = [(i, w) for i, w in known if w in mine]
                reach, hi, near = len(text) + GAP, 0, 0.0
                for lo, (start, word) in enumerate(at):
                    while hi < len(at) and at[hi][0] < start + reach:
                        near += idf[at[hi][1]] if at[hi][1] in rare else 0.0
                        hi += 1
                    if near >= least[t]:
                        weight, first, last = in_common(text, at[lo:hi], idf)
                        stretch = words[start : start + reach]
                        if weight >= COVERAGE * weights[t] and all(any(stretch[i : i + len(k)] == k for i in range(len(stretch))) for k in keys):
                            found.append((label, weight / weights[t], weight, first, last))
                    near -= idf[word] if word in rare else 0.0
            return settled(found)

        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").cast(pa.binary()):
                words = _words(text.as_py())
                distinct = set(words)
                present = postings & distinct
                places, labels = [], set()
                if distinct & ends:
                    where: dict[bytes, list[int]] = defaultdict(list)
                    firsts = {p[0] for p, _ in base}
                    for i, w in enumerate(words):
                        if w in firsts:
                            where[w].append(i)
                    for phrase, label in base:
                        if hits := _places(words, phrase, where):
                            labels.add(label)
                            places += [(i, i + len(phrase) - 1) for i in hits]
                more = aligned(words, present)
                starts = [p for p, _ in places]
                score = 1.0 if places else max((c for _, c in more), default=0.0)
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in more})), min(score, 1.0)))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. ``base`` are the
    phrases that count by themselves, in lower case with one space between words, and their labels."""
    docs = docs.select("doc_id", "text")
    counts = docs.mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = {r["word"].encode(): r["n"] for r in written(counts, "frequencies").collect()}  # at most the templates' words
    total = docs.count()
    idf = {w: math.log((total + 1) / (held.get(w, 0) + 1)) + 0.01 for w in _vocabulary()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        _scan(idf, base), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
