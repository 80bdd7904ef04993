"""Repeated byte strings by column-wise construction over many documents.

A collection's Burrows-Wheeler order is built one column at a time: each round puts one more
symbol in front of every row's suffix, re-orders the rows by a stable sort on that symbol, and
updates the common prefix of neighbours by a running minimum. Whole texts would need as many
rounds as the longest one has bytes, so the rows of the collection are clips: the bytes around
an anchor (``words.anchors``: a seed that is smallest in some window) that repeats somewhere. All
windows that can be equal hold the same anchor at the same distance, so clips are lined up at
their anchors and a column only has to be ordered against the same column of the clips of that
anchor. A clip takes at most ``2 * window`` bytes, so the rounds are bounded, whatever the texts.

The sequential external files are the written clip tables: equal clips are counted before the
shuffle (their windows repeat, and one copy stands for all), and each task reads the clips of
its anchors in order, a bounded block of anchors at a time. An anchor with more than
``BLOCK_CLIPS`` different clips is spread over tasks by what its windows hold: see ``_explode``.

Defined cases: null text is empty; texts shorter than the window have no window; a row that
occurs twice repeats itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm import words as W
from pricelens.llm.repeats import Keyed, repeated_places
from pricelens.llm.tables import same_row, with_row_key, written

SEED = 64
BLOCK_CLIPS = 20_000


def _seeds(b: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the seed at each byte, the anchors, and the sums behind the hashes."""
    n = len(b)
    sums = W.byte_sums(b)
    values = np.zeros(n, np.uint64)
    places = np.arange(max(0, n - SEED + 1))
    values[: len(places)] = W.byte_windows(sums, places, SEED)
    return values, W.anchors(values, offsets, SEED, window), sums


def _anchor_keys(window: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[Keyed]:
        for lo, _, b, offsets in W.slices(batch.column("text")):
            values, picked, _ = _seeds(b, offsets, window)
            if len(picked):
                rows = np.searchsorted(offsets, picked, side="right") - 1
                yield values[picked], np.zeros(len(picked), np.int32), rows + lo, picked - offsets[rows]

    return keys_of


def _owners(values: np.ndarray, picked: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole windows of all rows, and for each the first anchor with its smallest seed."""
    n = len(values)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + window <= offsets[rows + 1])
    lows = W.sliding(values, window - SEED + 1, np.minimum)[starts]
    marks = np.zeros(n, np.int64)
    marks[picked] = 1
    owner = (np.cumsum(marks) - marks)[starts]
    while len(late := np.flatnonzero(values[picked[owner]] != lows)):
        owner[late] += 1
    return starts, owner


def _clip_rows(window: int):
    """For every anchor that repeats, the bytes of the windows that it is the first smallest seed of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = W.listed(batch.column("places"))
            spans, _ = W.listed(batch.column("spans"))
            for lo, hi, b, offsets in W.slices(batch.column("text")):
                values, picked, sums = _seeds(b, offsets, window)
                if not len(picked):
                    continue
                starts, owner = _owners(values, picked, offsets, window)
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                wanted = W.fill_spans(len(b), held[at[lo] : at[hi]] + offsets[row], spans[at[lo] : at[hi]])
                mine = wanted[picked[owner]]
                starts, owner = starts[mine], owner[mine]
                if not len(starts):
                    continue
                heads = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
                first, last, owner = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], owner[heads]
                size = last + window - first
                raw = b.tobytes()
                rows = np.searchsorted(offsets, first, side="right") - 1
                take = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values[picked[owner]].view(np.int64)),
                        pa.array(W.byte_windows(sums, first, size).view(np.int64)),
                        pa.array(W.byte_windows(W.byte_sums(b, second=True), first, size, second=True).view(np.int64)),
                        pa.array((picked[owner] - first).astype(np.int32)),
                        pa.array([raw[f:e] for f, e in zip(first, first + size)], pa.binary()),
                        batch.column("doc_id").take(take),
                        batch.column("row_hash").take(take),
                        pa.array((first - offsets[rows]).astype(np.int32)),
                    ],
                    names=["anchor", "clip1", "clip2", "lead", "clip", "doc_id", "row_hash", "place"],
                )

    return run


def repeated_in_columns(groups: np.ndarray, leads: np.ndarray, clips: list[bytes], window: int) -> np.ndarray:
    """True at (clip, offset) where ``window`` bytes also stand, at the same distance from the anchor,
    in another clip of the group. groups: ascending group number of each clip."""
    m, lead = len(clips), int(leads.max())
    sizes = np.array([len(c) for c in clips])
    begin = lead - leads
    width = int((begin + sizes).max())
    symbols = np.full((width, m), -1, np.int16)
    flat = np.frombuffer(b"".join(clips), np.uint8)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[inner + np.repeat(begin, sizes), np.repeat(np.arange(m), sizes)] = flat
    found = np.zeros((m, int(sizes.max()) - window + 1), bool)
    order = np.arange(m)
    common = np.zeros(m, np.int64)  # of a row of the order and the row before it
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]
        perm = np.argsort(groups[order] * 257 + symbol + 1, kind="stable")
        symbol = symbol[perm]
        # Least common prefix on the way from a row to the next one with the same symbol.
        # The end put behind it closes the way to the last row, and is on no way itself.
        low = np.minimum.reduceat(np.append(common, 0), perm + 1)
        order = order[perm]
        own = groups[order]
        common = np.zeros(m, np.int64)
        same = (own[1:] == own[:-1]) & (symbol[1:] == symbol[:-1]) & (symbol[1:] >= 0)
        common[1:][same] = low[:-1][same] + 1
        long = common >= window
        if long.any():
            twice = long.copy()
            twice[:-1] |= long[1:]
            rows = order[twice]
            rows = rows[(column >= begin[rows]) & (column + window <= begin[rows] + sizes[rows])]
            found[rows, column - begin[rows]] = True
    return found


def _column_blocks(window: int):
    """Over clips in the order of their anchors: the offsets that repeat, by blocks of whole anchors."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        anchors = np.array([r[0] for r in rows])
        groups = np.cumsum(np.diff(anchors, prepend=anchors[:1]) != 0)
        several = np.bincount(groups)[groups] > 1
        some = np.flatnonzero(several)
        offsets: list[list[int]] = [list(range(len(r[4]) - window + 1)) if r[5] > 1 else [] for r in rows]
        if len(some):
            found = repeated_in_columns(groups[some], np.array([rows[i][3] for i in some]), [rows[i][4] for i in some], window)
            for i, hit in zip(some, found):
                if rows[i][5] == 1:
                    offsets[i] = np.flatnonzero(hit).tolist()
        keep = [i for i, x in enumerate(offsets) if x]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()),
                pa.array([rows[i][1] for i in keep], pa.int64()),
                pa.array([rows[i][2] for i in keep], pa.int64()),
                pa.array([offsets[i] for i in keep], pa.list_(pa.int32())),
            ],
            names=["anchor", "clip1", "clip2", "offsets"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "clip1", "clip2", "lead", "clip", "copies"))):
                if len(rows) >= BLOCK_CLIPS and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)

    return run


def _explode(window: int):
    """A key for each window of a clip. For anchors with very many different clips: equal windows
    then meet by what they hold, not by their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, b, offsets in W.slices(batch.column("clip")):
                rows = np.searchsorted(offsets, np.arange(len(b)), side="right") - 1
                starts = np.flatnonzero(np.arange(len(b)) + window <= offsets[rows + 1])
                take = pa.array(rows[starts] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.byte_windows(W.byte_sums(b), starts, window).view(np.int64)),
                        pa.array(W.byte_windows(W.byte_sums(b, second=True), starts, window, second=True).view(np.int64)),
                        *(batch.column(n).take(take) for n in ("anchor", "clip1", "clip2", "copies")),
                        pa.array((starts - offsets[rows[starts]]).astype(np.int32)),
                    ],
                    names=["key", "key2", "anchor", "clip1", "clip2", "copies", "offset"],
                )

    return run


def repeated_strings(docs: DataFrame, window: int = 200, block_clips: int = BLOCK_CLIPS) -> DataFrame:
    """(doc_id, row_hash, starts): the byte numbers at which ``window`` bytes start that also start
    anywhere else. docs needs doc_id, row_hash and text."""
    texts = docs.select("doc_id", "row_hash", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = written(repeated_places(texts, _anchor_keys(window)), "anchors", big=True)
    rows = texts.join(anchors, same_row(texts, anchors)).select(texts["*"], "places", "spans")
    clips = written(
        rows.mapInArrow(_clip_rows(window), f"anchor long, clip1 long, clip2 long, lead int, clip binary, doc_id {kind}, row_hash long, place int"),
        "clips",
        big=True,
    )
    different = written(
        clips.groupBy("anchor", "clip1", "clip2").agg(F.first("lead").alias("lead"), F.first("clip").alias("clip"), F.count("*").alias("copies")),
        "different",
        big=True,
    )
    counts = different.groupBy("anchor").agg(F.count("*").alias("n"))
    crowded = written(counts.where(F.col("n") > block_clips).select("anchor"), "crowded")
    found = (
        different.join(crowded, "anchor", "left_anti")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_column_blocks(window), "anchor long, clip1 long, clip2 long, offsets array<int>")
    )
    windows = different.join(crowded, "anchor", "left_semi").mapInArrow(
        _explode(window), "key long, key2 long, anchor long, clip1 long, clip2 long, copies long, offset int"
    )
    often = windows.groupBy("key", "key2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    rest = windows.join(often, ["key", "key2"], "left_semi").groupBy("anchor", "clip1", "clip2").agg(F.collect_list("offset").alias("offsets"))
    found = written(found.unionByName(rest), "found", big=True)
    places = clips.drop("clip").join(found, ["anchor", "clip1", "clip2"])
    starts = F.transform("offsets", lambda x: x + F.col("place"))
    return written(places.groupBy("doc_id", "row_hash").agg(F.array_distinct(F.flatten(F.collect_list(starts))).alias("starts")), "starts", big=True)


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = W.listed(batch.column("starts"))
            texts = batch.column("text").cast(pa.binary())
            sizes, removed, spans, digests = [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                starts = held[at[i] : at[i + 1]]
                sizes.append(len(text))
                gone = runs = 0
                if len(starts):
                    b = np.frombuffer(text, np.uint8)
                    covered = W.fill_spans(len(b), starts, window)
                    gone, runs = int(covered.sum()), int((np.diff(covered.astype(np.int8), prepend=0) > 0).sum())
                    text = b[~covered].tobytes()
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def digest(docs: DataFrame, window: int = 200) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (runs removed), kept_sha256 of the other bytes."""
    docs = with_row_key(docs.select("doc_id", "text"))
    found = repeated_strings(docs, window)
    rows = docs.join(found, same_row(docs, found), "left").select(docs["doc_id"], "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digest(window), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
