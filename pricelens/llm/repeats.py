"""Which keyed places of a table repeat: one shuffle, with what a task can see decided before it.

A map task counts the keys of its own rows first. Places whose key occurs twice there are decided
and leave as runs of neighbouring places; one witness of such a key still goes to the key's
partition, for single places elsewhere. So a key has at most one row per block of a map task in
the shuffle, however many places hold it, and no join brings the counts back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that a map task gathers before it counts them.
BLOCK_PLACES = 2_000_000
SINGLE, WITNESS, RUN = 0, 1, 2

#: Keys of one slice: key (uint64), second key (int32), row numbers in the batch, places in the rows.
Keyed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _decide(key: np.ndarray, key2: np.ndarray, row: np.ndarray, place: np.ndarray, doc_id: pa.Array, row_hash: pa.Array) -> pa.RecordBatch:
    order = np.lexsort((key2, key))
    k, k2 = key[order], key2[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (k2[1:] == k2[:-1])
    several = same[1:] | same[:-1]
    witness = order[several & ~same[:-1]]
    decided = np.zeros(len(key), bool)
    decided[order] = several
    single = np.flatnonzero(~decided)
    known = np.flatnonzero(decided)
    r, p = row[known], place[known]
    heads = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))) if len(known) else known
    spans = np.diff(np.append(heads, len(known)))
    picked = np.concatenate([single, witness, known[heads]])
    kinds = np.repeat(np.array([SINGLE, WITNESS, RUN], np.int8), [len(single), len(witness), len(heads)])
    take = pa.array(row[picked])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key[picked].view(np.int64)),
            pa.array(key2[picked]),
            pa.array(kinds),
            doc_id.take(take),
            row_hash.take(take),
            pa.array(place[picked].astype(np.int32)),
            pa.array(np.concatenate([np.ones(len(single) + len(witness), np.int32), spans.astype(np.int32)])),
        ],
        names=["key", "key2", "kind", "doc_id", "row_hash", "place", "span"],
    )


def _map_side(keys_of: Callable[[pa.RecordBatch], Iterator[Keyed]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[Keyed] = []
            size = 0
            for keyed in keys_of(batch):
                held.append(keyed)
                size += len(keyed[0])
                if size >= BLOCK_PLACES:
                    yield _decide(*map(np.concatenate, zip(*held)), batch.column("doc_id"), batch.column("row_hash"))
                    held, size = [], 0
            if size:
                yield _decide(*map(np.concatenate, zip(*held)), batch.column("doc_id"), batch.column("row_hash"))

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in key order: single places that share their key with a neighbour, and all runs."""
    names = ["doc_id", "row_hash", "place", "span"]
    last: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        runs = batch.filter(pa.array(np.asarray(batch.column("kind")) == RUN))
        if runs.num_rows:
            yield runs.select(names)
        rest = batch.filter(pa.array(np.asarray(batch.column("kind")) != RUN))
        if not rest.num_rows:
            continue
        if last is not None:
            rest = pa.Table.from_batches([last, rest]).combine_chunks().to_batches()[0]
        key, key2 = np.asarray(rest.column("key")), np.asarray(rest.column("key2"))
        same = np.zeros(len(key) + 1, bool)
        same[0] = before is not None and before == (key[0], key2[0])
        same[1:-1] = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])
        hit = (same[:-1] | same[1:]) & (np.asarray(rest.column("kind")) == SINGLE)
        done = rest.slice(0, len(key) - 1).filter(pa.array(hit[:-1]))
        if done.num_rows:
            yield done.select(names)
        last = rest.slice(len(key) - 1)
        before = (key[-2], key2[-2]) if len(key) > 1 else before
    if last is not None and before == (last.column("key")[0].as_py(), last.column("key2")[0].as_py()) and last.column("kind")[0].as_py() == SINGLE:
        yield last.select(names)


def repeated_places(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[Keyed]]) -> DataFrame:
    """(doc_id, row_hash, places, spans): runs of places whose keys occur more than once in all of
    ``rows``, which need doc_id and row_hash. A run is a first place and how many follow on."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"key long, key2 int, kind byte, doc_id {kind}, row_hash long, place int, span int"
    dealt = rows.mapInArrow(_map_side(keys_of), schema)
    # Runs are dealt by their row, keys by themselves.
    route = F.when(F.col("kind") == RUN, F.xxhash64("row_hash", "place")).otherwise(F.col("key"))
    dealt = dealt.repartition(route).sortWithinPartitions("key", "key2")
    again = dealt.mapInArrow(_neighbours, f"doc_id {kind}, row_hash long, place int, span int")
    runs = again.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("place", "span")).alias("runs"))
    return runs.select("doc_id", "row_hash", F.col("runs.place").alias("places"), F.col("runs.span").alias("spans"))
