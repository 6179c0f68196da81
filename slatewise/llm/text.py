"""Byte-level helpers shared by the text operators: Arrow buffers, words, shingle hashes, grouped partitions.

Everything works on whole texts in bounded blocks of rows; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20  # text bytes handled at once; a longer text makes a block of its own
SHINGLE = 5

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _GOLDEN) ^ np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(_BYTE)
_PLACE = mix64(np.arange(1, 2 * SHINGLE + 2, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash step, kept between calls."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 1024), _STEP, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `limit` bytes."""
    data, offsets = buffers(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a block, and each row's bounds in them."""
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    gap = IS_SPACE[data]
    solid = ~gap
    opens = solid.copy()
    opens[1:] &= gap[:-1] | ends[1:-1]
    starts = np.flatnonzero(opens)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    letters = LOWER[data[solid]]
    first = np.cumsum(solid)[starts] - 1
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    table = powers(int(lengths.max()))
    return mix64(np.add.reduceat(_BYTE[letters] * table[place], first) + lengths.astype(np.uint64) * _GOLDEN), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer words give one shingle, none an empty set."""
    hashes, bounds = words(data, offsets)
    counts = np.diff(bounds)
    joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        joined += hashes[j : j + len(joined)] * _PLACE[j]
    joined = mix64(joined)
    out = []
    for row, n in enumerate(counts):
        a = bounds[row]
        if n >= size:
            out.append(np.unique(joined[a : a + n - size + 1]))
        elif n:
            parts = np.append(hashes[a : a + n] * _PLACE[:n], _PLACE[size + n - 1])
            out.append(mix64(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal `key` in a stream whose partitions are sorted by it; one run is in memory at a time."""
    parts: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        codes = column.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if parts and codes[a] != current:
                yield current, pa.Table.from_batches(parts)
                parts = []
            current = codes[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield current, pa.Table.from_batches(parts)
