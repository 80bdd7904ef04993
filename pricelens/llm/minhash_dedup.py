"""Near copies by MinHash: universal hash minima, bands, signature check, exact check, components.

Rows with the same shingle set are one class with a number of its own, and only classes are
compared; doc_ids only name the components in the end, so rows that share an id but not the text are told apart. ``ROWS * BANDS`` minima of a class make ``BANDS`` band keys: two sets of similarity 0.85
share none with probability (1 - 0.85**5)**30 = 2e-8. Classes with a band in common are
candidates. First every class is compared with the least class of each of its bands; of what
that leaves in different components, the pairs of a band whose signatures agree enough are
compared inside the task that holds both, each pair in the first band it shares (in blocks, so
that no band, however large, is gathered, and only links leave the task). An exact comparison
of the full sets confirms each link. What is inside one component already is not compared again, so the
components come out as if all pairs had been.

Defined cases: null text and texts without words have an empty set and are linked with nothing;
with fewer words than a shingle the whole sequence is one shingle; a null doc_id is linked with
nothing, and its component is null; equal rows fall in one class; rows that share a doc_id are linked by their texts alone, and
each gets its own text's component; ids may be of any type with an order; very long texts are one slice each; an empty table gives an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm import words as W
from pricelens.llm.components import components
from pricelens.llm.tables import with_row_key, written

SHINGLE = 5
ROWS, BANDS = 5, 30
#: Classes of one band key that are compared with each other in one task.
BLOCK_CLASSES = 500
#: Signatures of sets of similarity 0.85 agree in 150 places by 0.85 +- 0.03; 0.7 is five deviations lower.
AGREE_MARGIN = 0.15

_RANDOM = np.random.Generator(np.random.PCG64(77))
_FACTORS = _RANDOM.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)


def shingles(b: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts in text order, and where each text's begin (with an end)."""
    b = W.lower_ascii(b)
    starts, stops, firsts = W.word_spans(b, offsets)
    words = W.word_hashes(b, starts, stops)
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(firsts[:-1], n)
    return W.word_windows(words, place, np.repeat(np.minimum(counts, size), n)), at


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, b, offsets in W.slices(batch.column("text")):
            values, at = shingles(b, offsets)
            rows = np.repeat(np.arange(hi - lo), np.diff(at))
            # A set: each hash once per row.
            order = np.lexsort((values, rows))
            values, rows = values[order], rows[order]
            once = np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])) if len(values) else np.zeros(0, bool)
            values, rows = values[once], rows[once]
            sizes = np.bincount(rows, minlength=hi - lo)
            full = np.flatnonzero(sizes)
            heads = np.searchsorted(rows, full)
            minima = np.zeros((ROWS * BANDS, hi - lo), np.uint64)
            sums = np.zeros((2, hi - lo), np.uint64)
            if len(full):
                for k in range(ROWS * BANDS):
                    minima[k, full] = np.minimum.reduceat(values * _FACTORS[k] + _TERMS[k], heads)
                sums[0, full] = np.add.reduceat(W.mix(values), heads)
                sums[1, full] = np.add.reduceat(W.mix(values ^ np.uint64(0xA24BAED4963EE407)), heads)
            bands = np.zeros((BANDS, hi - lo), np.uint64)
            for k in range(ROWS * BANDS):
                band = k // ROWS
                bands[band] = W.mix(bands[band] ^ minima[k]) + np.uint64(band)
            signature = np.ascontiguousarray((minima >> np.uint64(56)).astype(np.uint8).T)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    batch.column("row_hash").slice(lo, hi - lo),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(bands.T).reshape(-1).view(np.int64))
                    ),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                names=["doc_id", "row_hash", "n_shingles", "set1", "set2", "bands", "signature"],
            )


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for _, _, b, offsets in W.slices(column):
        values, at = shingles(b, offsets)
        out += [np.unique(values[i:j]) for i, j in zip(at[:-1], at[1:])]
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * union, on full sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) > 0


def _confirm(percent: int):
    """Over pairs with both texts: those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                keep = [_linked(x, y, percent) for x, y in zip(_sets(part.column("text_a")), _sets(part.column("text_b")))]
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _links_of_block(percent: int):
    """Over the classes of one block pair of a band key: the links between classes of different
    components. A pair is looked at in the first band it shares, and its full sets are compared
    if the signatures agree enough."""
    least = max(percent / 100 - AGREE_MARGIN, 0.0)

    def run(table: pa.Table) -> pa.Table:
        ids, comp, sides = (np.asarray(table.column(n)) for n in ("rep", "component", "side"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = W.listed(table.column("bands"))[0].reshape(len(ids), -1)
        here = table.column("bands_at")[0].as_py()
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        sets: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _sets(table.column("text").slice(i, 1))[0]
            return sets[i]

        links = set()
        for i in left:
            others = right[comp[right] != comp[i]]
            others = others[(signature[others] == signature[i]).mean(axis=1) >= least]
            for j in others[np.argmax(bands[others] == bands[i], axis=1) == here]:
                if _linked(full(i), full(j), percent):
                    links.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"), "confirmed", big=True)


SET = ["n_shingles", "set1", "set2"]


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a set (doc_id, row_hash and the set), and per set: rep, head (the least row with it), component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(
        docs.mapInArrow(_signatures, f"doc_id {kind}, row_hash long, n_shingles long, set1 long, set2 long, bands array<long>, signature binary"), "signatures"
    )
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    heads = linked.groupBy(*SET).agg(F.min(F.struct("doc_id", "row_hash")).alias("head"))
    # Numbers are given as the table is written, once.
    classes = written(heads.withColumn("rep", F.monotonically_increasing_id()), "classes", big=True)
    row = F.struct("doc_id", "row_hash")
    reps = linked.join(classes, SET).where(row == F.col("head")).dropDuplicates(["rep"]).select("rep", "bands", "signature")
    reps = written(reps, "reps", big=True)
    keyed = written(reps.select("rep", F.posexplode("bands").alias("bands_at", "band")), "bands")
    centres = keyed.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = written(keyed.join(centres, "band"), "shared", big=True)
    stars = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = classes.join(shared.select("rep").distinct(), "rep").select("rep", F.col("head.doc_id").alias("_id"), F.col("head.row_hash").alias("_hash"))
    texts = docs.join(wanted, (docs["doc_id"] == F.col("_id")) & (docs["row_hash"] == F.col("_hash")))
    texts = written(texts.select("rep", "text").dropDuplicates(["rep"]), "texts", big=True)
    links = _confirmed(stars, texts, percent)
    so_far = components(links)

    # Bands whose classes are not all in one component yet; a pair's first shared band is among them.
    placed = shared.join(so_far, shared["rep"] == so_far["node"], "left").select(
        "band", "bands_at", "rep", "members", F.coalesce("component", "rep").alias("component")
    )
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    placed = placed.join(mixed, "band").join(reps, "rep").join(texts, "rep")
    placed = placed.withColumn("blocks", F.ceil(F.col("members") / BLOCK_CLASSES).cast("int"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "bands_at", "rep", "component", "signature", "bands", "text",
        F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    more = written(dealt.groupBy("band", "first", "second").applyInArrow(_links_of_block(percent), "a long, b long"), "more", big=True)
    found = components(links.union(more))
    placed = classes.join(found, classes["rep"] == found["node"], "left").select(*SET, "rep", "head", F.coalesce("component", "rep").alias("component"))
    return signed, written(placed, "placed")


def near_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id of the component), kept."""
    signed, placed = _labelled(with_row_key(docs.select("doc_id", "text")), percent)
    named = placed.groupBy("component").agg(F.min("head.doc_id").alias("component_id"))
    labels = written(placed.join(named, "component").select(*SET, "component_id"), "labels")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.join(labels, SET, "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id stays, and of
    several with that id the one whose text has the least hash; of repeated rows one. Rows that are linked with nothing
    stay as they are: those without words or without an id, and every text without a copy, whatever other rows share its id.
    Columns of any name come back unchanged."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = with_row_key(docs.select("doc_id", "text", F.struct(*columns).alias("_row")))
    signed, placed = _labelled(keyed.select("doc_id", "text", "row_hash"), percent)
    heads = placed.groupBy("component").agg(F.min("head").alias("head")).select("head.doc_id", "head.row_hash")
    heads = written(heads, "heads")
    able = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "row_hash").agg(F.count("*").alias("rows")).where("rows > 1")
    repeated = written(heads.join(able, ["doc_id", "row_hash"], "left_semi"), "repeated")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(~alone).join(heads, ["doc_id", "row_hash"], "left_semi")
    once = kept.join(repeated, ["doc_id", "row_hash"], "left_semi").dropDuplicates(["doc_id", "row_hash"])
    kept = kept.join(repeated, ["doc_id", "row_hash"], "left_anti").unionByName(once)
    return keyed.where(alone).select("_row.*").unionByName(kept.select("_row.*"))
