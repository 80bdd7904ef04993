"""Ranked lexical search by bit-sliced Bloom signatures, exact in its result.

Every document sets ``HASHES`` bits of a signature for each of its terms, and again for each doubling that the term's
frequency reaches (2, 4, 8 ...). Documents of like size share a block, whose signatures are stored slice by slice: a bit
position is a bitmap over the documents. The AND of a term's slices holds every document with the term and a few others, and the
doublings bound the frequency from above. With a document's exact length, the weighted sum of these bounds over the terms of a query
is never under its score.

A query takes two passes over the blocks. The first keeps the ``PROBES`` documents with the highest bounds, whose exact scores give
a floor under the last place wanted. The second keeps every document whose bound reaches that floor. All of them are scored exactly from their
texts, so no document that could be ranked is lost, however loose the bounds are.

Score of a document with n of the L terms of N documents: the sum over the query's terms, repeats included, of
w * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L, w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Queries are taken in blocks of about ``PAIRS`` (query, term) pairs, which reach the driver; a longer query is a block of its own.
Defined cases: null and texts without terms are in no index and match nothing; repeated documents are ranked each; equal scores go
by doc_id, null last, then by text; equal queries are answered once, queries that share an id but not the text each; a very long text
is one block; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm import words as W
from pricelens.llm.decontamination import item_words
from pricelens.llm.importance_resampling import TABLE
from pricelens.llm.tables import with_row_key, written

TOP, PROBES = 10, 20
#: Bits set and bits held for an entry: a term that a document lacks seems present 3 times in 1,000.
HASHES, BITS = 3, 20
#: Documents of a block, bits of its signatures together, and documents gathered to be put in order of size.
BLOCK, BLOCK_BITS, GATHER, GATHER_ENTRIES = 1024, 1 << 24, 8192, 8_000_000
PAIRS = 20_000

_BLANKED = np.frombuffer(TABLE, np.uint8)
_SALTS = W.mix(np.arange(1, 65 + HASHES, dtype=np.uint64))


def _terms(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the terms of some texts, the text of each, the number of terms of each text, and where they stand."""
    b = _BLANKED[b]
    starts, stops, firsts = W.word_spans(b, offsets)
    counts = np.diff(firsts)
    return W.word_hashes(b, starts, stops), np.repeat(np.arange(len(counts)), counts), counts, (b, starts, stops)


def _slices_of(entries: np.ndarray, width: int) -> np.ndarray:
    """The ``HASHES`` slices of each entry."""
    return (W.mix(entries[:, None] ^ _SALTS[None, 64:]) % np.uint64(width)).astype(np.int64)


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    return W.mix(hashes + _SALTS[level])


def _blocks(held: list[tuple]) -> Iterator[tuple]:
    """(doc_ids, row_hashes, numbers of terms, width, slices) of gathered (doc_id, row_hash, n, entries)."""
    held.sort(key=lambda d: len(d[3]))
    lo = 0
    while lo < len(held):
        hi = lo + 1
        while hi < len(held) and hi - lo < BLOCK and (hi - lo + 1) * len(held[hi][3]) * BITS <= BLOCK_BITS:
            hi += 1
        part = held[lo:hi]
        width = len(part[-1][3]) * BITS
        bits = np.zeros((width, hi - lo), bool)
        at = np.repeat(np.arange(hi - lo), [len(d[3]) for d in part])
        found = _slices_of(np.concatenate([d[3] for d in part]), width)
        for k in range(HASHES):
            bits[found[:, k], at] = True
        yield [d[0] for d in part], [d[1] for d in part], [d[2] for d in part], width, np.packbits(bits, axis=1).tobytes()
        lo = hi


def _index(kind: pa.DataType):
    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, sizes, width, slices in _blocks(held):
            arrays = [
                pa.array([ids], pa.list_(kind)), pa.array([hashes], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([width], pa.int64()), pa.array([slices], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "row_hashes", "sizes", "width", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for lo, hi, b, offsets in W.slices(batch.column("text")):
                hashes, row, counts, _ = _terms(b, offsets)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                heads = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))) if len(row) else row
                times = np.diff(np.append(heads, len(row)))
                hashes, row = hashes[heads], row[heads]
                made, rows = [], []
                level = 0
                while len(hashes):
                    made.append(_entries(hashes, level))
                    rows.append(row)
                    level += 1
                    more = times >= 1 << level
                    hashes, row, times = hashes[more], row[more], times[more]
                entries = np.concatenate(made) if made else np.zeros(0, np.uint64)
                rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(hi - lo + 1))
                entries = entries[order]
                ids, keys = batch.column("doc_id").slice(lo, hi - lo).to_pylist(), batch.column("row_hash").slice(lo, hi - lo).to_pylist()
                for i in np.flatnonzero(counts):
                    held.append((ids[i], keys[i], int(counts[i]), entries[cuts[i] : cuts[i + 1]]))
                total += len(entries)
                if len(held) >= GATHER or total >= GATHER_ENTRIES:
                    yield from packed(held)
                    held, total = [], 0
        yield from packed(held)

    return run


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks of signatures of docs (doc_id, text): doc_ids, row_hashes, sizes, width, slices."""
    docs = with_row_key(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())
    schema = f"doc_ids array<{kind}>, row_hashes array<bigint>, sizes array<bigint>, width long, slices binary"
    return written(docs.mapInArrow(_index(arrow), schema), "index")


class Queries:
    """A block of queries inside a task: their terms, weights and the counts of the documents."""

    def __init__(self, queries: list[Counter[str]]):
        names = sorted({t for q in queries for t in q})
        self.terms = [t.encode() for t in names]
        at = {t: i for i, t in enumerate(names)}
        self.parts = [(np.array([at[t] for t in q], np.int64), np.array(list(q.values()), np.int64)) for q in queries]
        self.weights = np.zeros(len(names), np.int64)
        self.docs = self.length = 0

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each term."""
        b = np.frombuffer(b" ".join(self.terms), np.uint8)
        starts, stops, _ = W.word_spans(b, np.array([0, len(b)]))
        return W.word_hashes(b, starts, stops), _second(b, starts, stops)

    def know(self, counts: dict[int, int]) -> None:
        self.docs, self.length = counts.get(-1, 0), counts.get(-2, 0)
        self.weights = np.array([floor(1000 * log((2 * self.docs + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)

    def dampened(self, times, sizes):
        """The factor of a term's frequency in documents of these sizes."""
        return (10**9 * times) // (1000 * times + 8 * (25 + (75 * sizes * self.docs) // self.length))


def _second(b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return W.byte_windows(W.byte_sums(b, True), starts, stops - starts, True)


def _statistics(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = queries.hashes()
        order = np.argsort(first)
        sorted_first = first[order]
        found = np.zeros(len(first), np.int64)
        docs = length = 0
        for batch in batches:
            for _, _, b, offsets in W.slices(batch.column("text")):
                hashes, row, counts, (b, starts, stops) = _terms(b, offsets)
                docs, length = docs + int((counts > 0).sum()), length + len(hashes)
                place = np.minimum(np.searchsorted(sorted_first, hashes), len(first) - 1)
                hit = np.flatnonzero(sorted_first[place] == hashes)
                term = order[place[hit]]
                true = _second(b, starts[hit], stops[hit]) == second[term] if len(hit) else np.zeros(0, bool)
                pairs = np.unique(row[hit][true] * len(first) + term[true])
                found += np.bincount(pairs % len(first), minlength=len(first))
        some = np.flatnonzero(found)
        terms, n = np.append(some, [-1, -2]), np.append(found[some], [docs, length])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    return run


def _bounds(queries: Queries, hashes: np.ndarray, sizes: np.ndarray, width: int, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, queries by documents of a block."""
    n = len(sizes)
    rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
    levels = np.zeros((len(hashes), n), np.uint8)
    some, before, level = np.arange(len(hashes)), None, 0
    while len(some):
        there = np.bitwise_and.reduce(rows[_slices_of(_entries(hashes[some], level), width)], axis=1)
        if before is not None:
            there &= before
        hold = there.any(axis=1)
        some, before = some[hold], there[hold]
        levels[some] += np.unpackbits(before, axis=1, count=n)
        level += 1
    # A term seen up to doubling k stands at most 2 ** k - 1 times in the document.
    factors = np.stack([queries.dampened((1 << k) - 1, sizes) for k in range(level + 1)])
    held = levels.any(axis=1)
    columns = np.arange(n)
    out = np.zeros((len(queries.parts), n), np.int64)
    for i, (terms, times) in enumerate(queries.parts):
        mine = held[terms]
        terms, times = terms[mine], times[mine]
        if len(terms):
            out[i] = ((times * queries.weights[terms])[:, None] * factors[levels[terms], columns]).sum(axis=0)
    return out


def _scanned(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: doc_ids, row_hashes, bounds."""
    hashes, _ = queries.hashes()
    for batch in batches:
        for i in range(batch.num_rows):
            ids, keys, sizes, width, slices = (batch.column(n)[i].as_py() for n in ("doc_ids", "row_hashes", "sizes", "width", "slices"))
            held = np.empty(len(ids), object)
            held[:] = ids
            yield held, np.array(keys, np.int64), _bounds(queries, hashes, np.array(sizes, np.int64), width, slices)


def _highest(queries: Queries, probes: int, kind: pa.DataType):
    """The documents with the highest bounds of each query, of all blocks of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries.parts), probes), np.int64)
        best_ids, best_keys = np.empty(best.shape, object), np.zeros(best.shape, np.int64)
        for ids, keys, bounds in _scanned(batches, queries):
            for q in np.flatnonzero(bounds.max(axis=1) > best.min(axis=1)):
                able = np.flatnonzero(bounds[q] > best[q].min())
                values = np.append(best[q], bounds[q][able])
                top = np.argsort(-values, kind="stable")[:probes]
                best_ids[q], best_keys[q] = np.append(best_ids[q], ids[able])[top], np.append(best_keys[q], keys[able])[top]
                best[q] = values[top]
        q, k = np.nonzero(best)
        arrays = [pa.array(q, pa.int32()), pa.array(best_ids[q, k].tolist(), kind), pa.array(best_keys[q, k]), pa.array(best[q, k])]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "row_hash", "bound"])

    return run


def _not_excluded(queries: Queries, floors: np.ndarray, kind: pa.DataType):
    """Documents with the queries whose floor their bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, bounds in _scanned(batches, queries):
            able = bounds >= floors[:, None]
            some = np.flatnonzero(able.any(axis=0))
            if len(some):
                asked = [np.flatnonzero(able[:, j]).tolist() for j in some]
                arrays = [pa.array(ids[some].tolist(), kind), pa.array(keys[some]), pa.array(asked, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row_hash", "queries"])

    return run


def _score(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[(queries.terms[t], int(n * queries.weights[t])) for t, n in zip(*part)] for part in queries.parts]
        for batch in batches:
            rows, asked, scores = [], [], []
            texts = batch.column("text").cast(pa.binary())
            for i, wanted in enumerate(batch.column("queries").to_pylist()):
                counts = Counter((texts[i].as_py() or b"").translate(TABLE).split())
                size = counts.total()
                for q in wanted:
                    score = sum(w * queries.dampened(counts[t], size) for t, w in parts[q] if t in counts)
                    if score > 0:
                        rows.append(i), asked.append(q), scores.append(score)
            take = pa.array(rows, pa.int64())
            arrays = [pa.array(asked, pa.int32()), batch.column("doc_id").take(take), batch.column("row_hash").take(take), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "row_hash", "score"])

    return run


def _scored(docs: DataFrame, wanted: DataFrame, queries: Queries, kind: str) -> DataFrame:
    """Exact scores of ``wanted`` (doc_id, row_hash, queries)."""
    named = wanted.toDF("_id", "_hash", "queries")
    texts = docs.join(named, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["row_hash"] == F.col("_hash"))).select("doc_id", "row_hash", "text", "queries")
    return texts.mapInArrow(_score(queries), f"query int, doc_id {kind}, row_hash long, score long")


def _ranked(scores: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row_hash")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """The ``top`` documents of each item (item_id, text): item_id, rank, doc_id, row_hash, score. ``index``: what build_index made of docs."""
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    docs = with_row_key(docs.select("doc_id", "text"))
    field = docs.schema["doc_id"].dataType
    kind, item_kind = field.simpleString(), items.schema["item_id"].dataType.simpleString()
    arrow = index.select(F.explode("doc_ids").alias("x")).limit(0).toArrow().schema.field("x").type
    # A row of the items counts once, however often it is repeated.
    once = items.select("item_id", "text").distinct()
    terms = once.select("item_id", F.xxhash64("text").alias("key"), F.explode(item_words("text")).alias("term"))
    pairs = written(terms.groupBy("item_id", "key", "term").agg(F.count("*").alias("n")), "item_terms")
    blocks = -(-pairs.count() // PAIRS)
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, row_hash long, score long")
    for block in range(blocks):
        asked: dict[tuple, Counter[str]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)) == block).collect():
            asked.setdefault((r["item_id"], r["key"]), Counter())[r["term"]] = r["n"]
        if not asked:
            continue
        names = list(asked)
        queries = Queries([asked[x] for x in names])
        counted = docs.select("text").mapInArrow(_statistics(queries), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        queries.know({r["term"]: r["n"] for r in counted.collect()})
        if not queries.length:
            continue
        probed = index.mapInArrow(_highest(queries, max(PROBES, 2 * top), arrow), f"query int, doc_id {kind}, row_hash long, bound long")
        probed = _ranked(probed.withColumnRenamed("bound", "score"), max(PROBES, 2 * top))
        probed = written(probed.groupBy("doc_id", "row_hash").agg(F.collect_set("query").alias("queries")), "probes")
        scores = _ranked(_scored(docs, probed, queries, kind), top).where(F.col("rank") == top).collect()
        floors = np.ones(len(names), np.int64)
        for r in scores:
            floors[r["query"]] = r["score"]
        able = written(index.mapInArrow(_not_excluded(queries, floors, arrow), f"doc_id {kind}, row_hash long, queries array<int>"), "not_excluded")
        able = able.groupBy("doc_id", "row_hash").agg(F.first("queries").alias("queries"))
        ranked = _ranked(_scored(docs, able, queries, kind), top)
        items_of = spark.createDataFrame([(i, x[0]) for i, x in enumerate(names)], f"query int, item_id {item_kind}")
        found = ranked.join(F.broadcast(items_of), "query").select("item_id", "rank", "doc_id", "row_hash", "score")
        out = out.unionByName(written(found, "found"))
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item and place: item_id, rank, doc_id, score."""
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(w) AS term FROM b) GROUP BY item_id, term),
t AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 10
"""
