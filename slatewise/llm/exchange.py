"""Counting fingerprints over all documents: units of text send what they hold, ranges of fingerprints answer.

A unit is a bounded block of documents with an id that a written table fixes.  It sends its distinct 64-bit
fingerprints with values, cut by fingerprint range; a range adds up the values of equal fingerprints of all units and
answers each unit that asked.  A fingerprint leaves a unit once however often the unit holds it, and ranges cut a hash,
so a frequent phrase weighs no more than one entry for each unit.  Lists travel packed: sorted, as differences, in byte
planes, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_ENTRIES = 4 << 20  # entries of one range before units merge theirs; sizes the number of ranges
SENT = "range long, unit long, prints binary, amounts binary"
ANSWER = "unit long, prints binary"


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """64-bit integers as compressed byte planes; sorted ones as differences."""
    values = np.ascontiguousarray(values).view(np.uint64)
    if ordered and len(values):
        values = np.append(values[:1], np.diff(values))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, ordered: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ordered else values


def tally(prints: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and their summed integer weights, 1 each without weights."""
    if weights is None:
        found, counts = np.unique(prints, return_counts=True)
        return found, counts.astype(np.int64)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def lookup(table: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of every fingerprint."""
    if not len(table):
        return np.zeros(len(prints), np.int64), np.zeros(len(prints), bool)
    at = np.minimum(np.searchsorted(table, prints), len(table) - 1)
    return at, table[at] == prints


def ranges_for(entries: int) -> int:
    return max(1, -(-entries // RANGE_ENTRIES))


def _cuts(prints: np.ndarray, n_ranges: int) -> list[int]:
    bounds = [(i << 64) // n_ranges for i in range(1, n_ranges)]
    return [0, *np.searchsorted(prints, np.array(bounds, np.uint64)).tolist(), len(prints)]


def sending(unit: int, prints: np.ndarray, amounts: np.ndarray, n_ranges: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of SENT for a unit's sorted distinct fingerprints."""
    cuts = _cuts(prints, n_ranges)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            yield i, unit, pack(prints[a:b], ordered=True), pack(amounts[a:b])


def sending_tallies(unit: int, tallies: list[tuple[np.ndarray, np.ndarray]], n_ranges: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """As :func:`sending` for the sum of several tallies; each range is added up by itself, so the whole list is never sorted at once."""
    cuts = [_cuts(prints, n_ranges) for prints, _ in tallies]
    for i in range(n_ranges):
        parts = [(prints[c[i] : c[i + 1]], amounts[c[i] : c[i + 1]]) for (prints, amounts), c in zip(tallies, cuts, strict=True) if c[i] < c[i + 1]]
        if parts:
            prints, amounts = tally(np.concatenate([p for p, _ in parts]), np.concatenate([a for _, a in parts]).astype(np.int64))
            yield i, unit, pack(prints, ordered=True), pack(amounts)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


SENT_ARROW = pa.schema([("range", pa.int64()), ("unit", pa.int64()), ("prints", pa.binary()), ("amounts", pa.binary())])
ANSWER_ARROW = pa.schema([("unit", pa.int64()), ("prints", pa.binary())])
BATCH_ROWS = 64


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch(held, schema)
            held = []
    if held:
        yield batch(held, schema)


def _added(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, their lists, own values, totals of the listed ones, distinct fingerprints, their totals) of one range."""
    units = table["unit"].to_numpy()
    lists = [unpack(b, ordered=True) for b in table["prints"].to_pylist()]
    own = np.concatenate([unpack(b) for b in table["amounts"].to_pylist()]).view(np.int64)
    prints = np.concatenate(lists)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    opens = np.append(True, ordered[1:] != ordered[:-1])
    first = np.flatnonzero(opens)
    sums = np.add.reduceat(own[order], first)
    totals = np.empty(len(prints), np.int64)
    totals[order] = sums[np.cumsum(opens) - 1]
    return units, lists, own, totals, ordered[first], sums


def answers(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(unit, prints): those of a unit's fingerprints that ``reply(totals, own)`` marks."""

    def answered(table: pa.Table) -> pa.Table:
        units, lists, own, totals, _, _ = _added(table)
        marked = reply(totals, own)
        out, a = [], 0
        for unit, prints in zip(units.tolist(), lists, strict=True):
            pick = np.flatnonzero(marked[a : a + len(prints)])
            if len(pick):
                out.append((unit, pack(prints[pick], ordered=True)))
            a += len(prints)
        return pa.Table.from_batches([batch(out, ANSWER_ARROW)])

    return sent.groupBy("range").applyInArrow(answered, ANSWER)


MORE = "range long, unit long, amounts binary"
MORE_ARROW = pa.schema([("range", pa.int64()), ("unit", pa.int64()), ("amounts", pa.binary())])


def others(sent: DataFrame, summary: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(range, unit, amounts): what other units add to each fingerprint of a unit, in the order it sent them.

    The fingerprints need not travel back, and most amounts are 0.  ``summary(prints, totals)`` gives integers on a
    range as a whole; they come as amounts of a row of unit -1.
    """
    return _replies(sent, lambda totals, own: totals - own, summary)


def marks(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(range, unit, amounts): 1 for those of a unit's fingerprints that ``reply(totals, own)`` marks, else 0, in the order it sent them."""
    return _replies(sent, lambda totals, own: reply(totals, own).astype(np.int64), None)


def _replies(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray], np.ndarray], summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:

    def answered(table: pa.Table) -> pa.Table:
        units, lists, own, totals, prints, sums = _added(table)
        number = table["range"][0].as_py()
        cuts = np.cumsum([0] + [len(x) for x in lists])
        given = reply(totals, own)
        out = [(number, unit, pack(given[a:b])) for unit, a, b in zip(units.tolist(), cuts, cuts[1:], strict=False)]
        if summary is not None:
            out.append((number, -1, pack(summary(prints, sums).astype(np.int64))))
        return pa.Table.from_batches([batch(out, MORE_ARROW)])

    return sent.groupBy("range").applyInArrow(answered, MORE)


def in_order(table: pa.Table) -> np.ndarray:
    """All of ``others``' amounts for one unit, in the order of its fingerprints."""
    table = table.sort_by("range")
    amounts = [unpack(b).view(np.int64) for b in table["amounts"].to_pylist()]
    return np.concatenate(amounts) if amounts else np.zeros(0, np.int64)


def joined(table: pa.Table) -> np.ndarray:
    """The fingerprints of all answers to one unit, sorted."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(b, ordered=True) for b in table["prints"].to_pylist()]]))


def count_of(frame: DataFrame, column: str) -> int:
    return frame.agg(F.coalesce(F.sum(column), F.lit(0)).alias("n")).first()["n"]
