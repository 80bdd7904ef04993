"""Words, hashes and windows of many texts at once, on numpy arrays inside a task.

A task hands over slices of about a megabyte, so memory does not depend on the batch; a
longer text is one slice. Every function takes whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15 | 3
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 3
_SECOND_BASE = 0xD6E8FEB86659FD93 | 3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(base, -1, 2**64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        held = _POWERS[base] = (made[0], made[1])
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spaces(b: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09-0x0D."""
    return (b == 32) | ((b >= 9) & (b <= 13))


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word between spaces, and the word number at which each row
    starts (one more entry than rows)."""
    inside = ~spaces(b)
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(b)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = offsets[offsets > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    p, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    _, inverse = powers(base, len(sums))
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def byte_sums(b: np.ndarray, second: bool = False) -> np.ndarray:
    return prefix_sums(_BYTE_VALUES[b ^ np.uint8(0xA5)], _SECOND_BASE) if second else prefix_sums(_BYTE_VALUES[b], _BYTE_BASE)


def byte_windows(sums: np.ndarray, starts: np.ndarray, length: int | np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of ``length`` bytes from each start, from ``byte_sums`` of the same function."""
    return span_hashes(sums, starts, starts + length, _SECOND_BASE if second else _BYTE_BASE)


def word_hashes(b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return span_hashes(byte_sums(b), starts, stops, _BYTE_BASE)


def word_windows(words: np.ndarray, starts: np.ndarray, length: int | np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of ``length`` consecutive words from each start; ``second`` is another function."""
    base = _SECOND_BASE if second else _WORD_BASE
    values = mix(words ^ np.uint64(0x5851F42D4C957F2D)) if second else words
    return span_hashes(prefix_sums(values, base), starts, starts + length, base)


def row_of(firsts: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of n items; ``firsts`` as given by word_spans."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:n]


def sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over x[i : i + k] for every i with a full window."""
    if len(x) < k:
        return x[:0]
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(values: np.ndarray, firsts: np.ndarray, seed: int, window: int) -> np.ndarray:
    """Positions of the seeds with the smallest value within some whole window.

    values: the hash of the ``seed`` items from each position (anything where a seed would leave
    its row). Two equal windows have their smallest seeds at the same places, so a window
    that occurs twice always has an anchor that occurs twice; about 2 in window - seed + 2
    positions are anchors.
    """
    n, k = len(values), window - seed + 1
    if n < k:
        return np.zeros(0, np.int64)
    lows = sliding(values, k, np.minimum)
    fits = np.zeros(n + 1, dtype=np.int32)
    sizes = np.diff(firsts)
    big = sizes >= window
    np.add.at(fits, firsts[:-1][big], 1)
    np.add.at(fits, firsts[1:][big] - window + 1, -1)
    fits = np.cumsum(fits)[: len(lows)] > 0
    lows = np.where(fits, lows, np.uint64(0))
    padded = np.concatenate([np.zeros(k - 1, np.uint64), lows, np.zeros(k - 1, np.uint64)])
    highs = sliding(padded, k, np.maximum)[:n]
    return np.flatnonzero((highs == values) & (highs > 0))


def fill_spans(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """True at the items that some span from ``starts`` covers."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, n), -1)
    return np.cumsum(marks)[:n] > 0


def listed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column, empty for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lengths)])
