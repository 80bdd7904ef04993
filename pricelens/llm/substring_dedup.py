"""Repeated word passages by level-wise doubling.

Windows repeated at one length alone are looked at again at twice that length, up to the wanted
window, or until no candidate is left. At the lengths before the last, only anchor windows are
counted (see ``words.anchors``): every repeated window holds one that repeats with it, so nothing
is lost and about a tenth of the positions is shuffled. At the last length every
window that holds a surviving candidate is counted. Keys are 96 bits of two hash functions.

Defined cases: null text has no words; texts shorter than the window have no window; a row that
occurs twice repeats itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.llm import words as W
from pricelens.llm.repeats import Keyed, repeated_places
from pricelens.llm.tables import same_row, with_row_key, written

#: Windows of at least this many words before the first doubling.
FIRST_LENGTH = 16


def lengths_to(window: int, first: int = FIRST_LENGTH) -> list[int]:
    """Lengths that double up to ``window``: 35 -> 18, 35."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= first:
        out.insert(0, half)
    return out


def _keys(length: int, window: int, before: int):
    """Candidate windows of ``length`` words: those near the places that repeated at ``before``
    words (0: all)."""

    def keys_of(batch: pa.RecordBatch) -> Iterator[Keyed]:
        if before:
            held, at = W.listed(batch.column("places"))
            spans, _ = W.listed(batch.column("spans"))
        for lo, hi, b, offsets in W.slices(batch.column("text")):
            starts, stops, firsts = W.word_spans(b, offsets)
            n = len(starts)
            if n < length:
                continue
            words = W.word_hashes(b, starts, stops)
            places = np.arange(n - length + 1)
            values = np.zeros(n, np.uint64)
            values[: len(places)] = W.word_windows(words, places, length)
            rows = W.row_of(firsts, n)
            if length < window:
                picked = W.anchors(values, firsts, length, window)
            else:
                picked = np.flatnonzero(np.arange(n) + length <= firsts[1:][rows])
            if before:
                # Windows that hold a surviving place; before the last length, all that such windows hold.
                owner = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                seen, run = held[at[lo] : at[hi]] + firsts[owner], spans[at[lo] : at[hi]]
                left = np.maximum(seen - (window - before), firsts[owner])
                right = seen + run + (window - before if length < window else 0)
                picked = picked[W.fill_spans(n, left, right - left)[picked]]
            if not len(picked):
                continue
            if length < window:
                second = np.zeros(len(picked), np.int32)
            else:
                second = (W.word_windows(words, picked, length, second=True) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield values[picked], second, rows[picked] + lo, picked - firsts[rows[picked]]

    return keys_of


def repeated_windows(docs: DataFrame, window: int = 35, lengths: list[int] | None = None) -> DataFrame:
    """(doc_id, row_hash, places, spans): runs of word numbers at which a window of ``window`` words
    starts whose words also start anywhere else. docs needs doc_id, row_hash and text."""
    texts = docs.select("doc_id", "row_hash", "text")
    found, before = None, 0
    for length in lengths or lengths_to(window):
        rows = texts
        if found is not None:
            rows = texts.join(found, same_row(texts, found)).select(texts["*"], "places", "spans")
        found = written(repeated_places(rows, _keys(length, window, before)), f"repeats{length}", big=True)
        before = length
    return found


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = W.listed(batch.column("places"))
            spans, _ = W.listed(batch.column("spans"))
            sizes, removed, digests = [], [], []
            texts = batch.column("text").cast(pa.binary())
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                starts, run = held[at[i] : at[i + 1]], spans[at[i] : at[i + 1]]
                sizes.append(len(words))
                if len(starts):
                    gone = W.fill_spans(len(words), starts, run + (window - 1))
                    removed.append(int(gone.sum()))
                    words = [words[j] for j in np.flatnonzero(~gone)]
                else:
                    removed.append(0)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = W.listed(batch.column("places"))
            spans, _ = W.listed(batch.column("spans"))
            column = batch.column("text")
            texts, empty = [], []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                starts, run = held[at[i] : at[i + 1]], spans[at[i] : at[i + 1]]
                none_left = False
                if len(starts):
                    b = np.frombuffer(text.encode(), np.uint8)
                    begin, end, _ = W.word_spans(b, np.array([0, len(b)]))
                    gone = W.fill_spans(len(begin), starts, run + (window - 1))
                    none_left = bool(gone.all())
                    upto = np.append(begin[1:], len(b))
                    drop = np.zeros(len(b) + 1, np.int64)
                    np.add.at(drop, begin[gone], 1)
                    np.add.at(drop, upto[gone], -1)
                    text = b[np.cumsum(drop)[:-1] == 0].tobytes().decode()
                texts.append(text)
                empty.append(none_left)
            names = batch.schema.names
            arrays = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names if n not in ("places", "spans")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(empty, pa.bool_())], names=[*(n for n in names if n not in ("places", "spans")), "none_left"])

    return run


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space."""
    docs = with_row_key(docs.select("doc_id", "text"))
    found = repeated_windows(docs, window)
    rows = docs.join(found, same_row(docs, found), "left").select(docs["doc_id"], "text", "places", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digest(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents without the words of repeated windows; what stays keeps its spacing. Rows that
    lose nothing come back as they are, rows of which no word is left go. ``n_chars``, when there,
    is counted again. Repeated rows and ids are rows like others, a very long text is stripped as a whole, and
    the other columns, whatever their names, come back unchanged."""
    columns = docs.columns
    keyed = with_row_key(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("rest")))
    found = repeated_windows(keyed, window)
    rows = keyed.join(found, same_row(keyed, found), "left").select(keyed["doc_id"], "text", "rest", "places", "spans")
    out = rows.mapInArrow(_strip(window), StructType([f for f in rows.schema.fields if f.name not in ("places", "spans")]).add("none_left", "boolean"))
    out = out.where("not none_left").select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in columns])
