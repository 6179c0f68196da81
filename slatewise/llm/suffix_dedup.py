"""Exact repeated strings by external induced suffix sorting, sharded.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts anywhere else in the corpus.

*Sample suffixes.*  In every window of LENGTH bytes the least hash of its ``GRAM``-byte strings marks a sample suffix
(the leftmost on ties).  Equal windows mark equal places, so a repeated window is found at an equal distance from equal
samples.  A window starts at most ``SPAN`` bytes before its sample; the distances fall into two halves, and the
bytes that all windows of one half share, its core, name the half: windows can be equal only where cores are.
Cores that occur once are dropped by a count over hash buckets; the others, with the bytes that their windows may
reach, are dealt into shards by the hash of the core.

*Induced sorting.*  A shard sorts the suffixes of its records by induction.  All records begin as one
class at the end of their bytes.  Passing to the byte before, the tuples (record, common prefix) leave a queue in
suffix order and enter the queue of the next level under that byte; a byte's bucket receives them in the order of
the suffixes they precede, so the new queue is in suffix order again, and the common prefix of neighbours is one
more than the least common prefix passed since the byte's last tuple.  The recursion ends at the first byte.  At
each level where a window starts, runs of common prefixes of LENGTH or more are the repeated windows.  Records
lie in a spool file and queues in mapped files once they exceed ``MEMORY`` bytes; passes run in slices, so a shard may be
far larger than memory.

Texts that occur several times fold into one for the search, and count as repeated whole.  Texts are shuffled by
their hash twice: to the search where they hold repeated cores, and to the removal.

Defined cases: null texts are empty; texts under LENGTH bytes lose nothing; matches never cross texts and
are judged on the input; null ids and repeated rows are rows like others.  Extra columns are ignored.  Rows are told apart
by a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.text import _BYTE, _STEP, blocks, groups, mix64, powers
from slatewise.session import stored

LENGTH = 200
GRAM = 40
SPAN = LENGTH - GRAM  # a window starts at most so many bytes before its sample
HALF = SPAN // 2
#: Of each half: least and most distance from window start to sample.
HALVES = ((0, HALF), (HALF + 1, SPAN))
BLOCK = 1 << 20  # text bytes hashed at once
BUCKET = 1_000_000  # cores of a bucket, about
FLUSH = 2_000_000  # cores a task gathers before it writes blobs
SHARD = 60_000  # records of a shard, about
HELD = 20_000  # records a task gathers before it sends them on
MEMORY = 48 << 20
SLICE = 1 << 16

_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        base = np.full(n, _INVERSE, np.uint64)
        base[0] = 1
        _inverses = np.multiply.accumulate(base)
    return _inverses


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width`, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, width), 1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sample_cores(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, sample place in the row, half, core hash) of every sample that some window of a row marks."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    # int64 running sums of powers wrap around, which is arithmetic modulo 2^64
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(len(data))[: len(data)], dtype=np.uint64)])
    inverse = inverse_powers(len(data) + 1)
    grams = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM]
    places = np.arange(len(grams), dtype=np.uint64)
    # upper half of the hash, then the place: ties go to the left
    marked = _least_in_windows((mix64(grams) & np.uint64(0xFFFFFFFF00000000)) | places, SPAN + 1) & np.uint64(0xFFFFFFFF)
    starts = np.arange(len(marked))
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(marked)]
    fits = starts + LENGTH <= room
    starts, sample = starts[fits], marked[fits].astype(np.int64)
    second = sample - starts > HALF
    code = sample * 2 + ~second
    keep = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    sample, half = sample[keep], second[keep].astype(np.int64)
    least, most = np.array([h[0] for h in HALVES])[half], np.array([h[1] for h in HALVES])[half]
    first, end = sample - least, sample - most + LENGTH
    core = mix64((sums[end] - sums[first]) * inverse[first] + half.astype(np.uint64))
    row = np.searchsorted(offsets, sample, "right") - 1
    return row, sample - offsets[row], half, core


def _core_blobs(n_buckets: int):
    """Blobs of core hashes by bucket: low halves, codes (2 * sample + half), and which of the listed texts each is from."""

    def packed(texts: list[int], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        owner, code, core = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bucket = ((core >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        owner, code, low, names = owner[order], code[order], core[order].astype(np.uint32), np.array(texts, np.int64)
        out = []
        for k in range(n_buckets):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                listed, place = np.unique(owner[a:b], return_inverse=True)
                out.append((k, low[a:b].tobytes(), code[a:b].tobytes(), place.astype(np.uint16).tobytes(), names[listed].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[i] for x in out], pa.binary()) for i in range(1, 5))], names=["bucket", "cores", "codes", "place", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, parts, held, seen = [], [], 0, set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in blocks(batch.column(1), BLOCK):
                row, sample, half, core = sample_cores(data, offsets)
                fresh = np.array([keys[i] not in seen and not seen.add(keys[i]) for i in range(a, b)])
                number = np.cumsum(fresh) - 1 + len(texts)
                take = fresh[row] if len(row) else np.zeros(0, bool)
                texts += [keys[a + i] for i in np.flatnonzero(fresh).tolist()]
                parts.append((number[row[take]], (sample[take] * 2 + half[take]).astype(np.uint32), core[take]))
                held += int(take.sum())
                if held >= FLUSH or len(texts) > 60_000:
                    yield from _flushed(texts, parts, packed)
                    texts, parts, held, seen = [], [], 0, set()
        yield from _flushed(texts, parts, packed)

    return run


def _flushed(texts: list[int], parts: list, packed) -> Iterator[pa.RecordBatch]:
    if len(texts) <= 65_536:
        if parts:
            yield packed(texts, parts)
        return
    owner, code, core = (np.concatenate([p[i] for p in parts]) for i in range(3))
    for a in range(0, len(texts), 65_536):
        mine = (owner >= a) & (owner < a + 65_536)
        yield packed(texts[a : a + 65_536], [(owner[mine] - a, code[mine], core[mine])])


def _repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket, the (text, codes) whose core occurs at two places or more."""
    cores, codes, texts = [], [], []
    for core, code, place, listed in zip(*(table[c].to_pylist() for c in ("cores", "codes", "place", "texts")), strict=True):
        cores.append(np.frombuffer(core, np.uint32))
        codes.append(np.frombuffer(code, np.uint32).astype(np.int64))
        texts.append(np.frombuffer(listed, np.int64)[np.frombuffer(place, np.uint16)])
    core, code, text = np.concatenate(cores), np.concatenate(codes), np.concatenate(texts)
    order = np.lexsort((code, text, core))
    core, code, text = core[order], code[order], text[order]
    fresh = np.append(True, (core[1:] != core[:-1]) | (text[1:] != text[:-1]) | (code[1:] != code[:-1])) if len(core) else np.zeros(0, bool)
    core, code, text = core[fresh], code[fresh], text[fresh]
    same = core[1:] == core[:-1]
    twice = np.append(same, False) | np.append(False, same) if len(core) else np.zeros(0, bool)
    code, text = code[twice], text[twice]
    order = np.argsort(text, kind="stable")
    code, text = code[order], text[order]
    cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(text)).astype(np.int32)), pa.array(code))
    return pa.table({"text_key": pa.array(text[cuts] if len(cuts) else np.zeros(0, np.int64)), "codes": lists})


WIDTH = LENGTH + HALF  # bytes that the windows of one half may reach


RECORD = "shard long, text_key long, code long, first short, end short, content binary, a long, b long"


def _records(n_shards: int):
    """Records of texts' repeated cores: shard, sample code, the bytes in reach and which of them exist.

    Equal records that meet in a task are repeated whole: their interval (a, b) is known at once and travels
    without bytes, and one of them stands for all, so that a passage of many documents sends a few records a task.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int64(), pa.int64())

    def packed(held: dict[tuple[int, bytes], list[tuple[int, int]]], clipped: list[tuple]) -> pa.RecordBatch:
        rows, known = clipped, {}
        for (shard, content), members in held.items():
            rows.append((shard, *members[0], 0, WIDTH, content, None, None))
            for key, code in members if len(members) > 1 else ():
                a = (code >> 1) - HALVES[code & 1][1]
                known.setdefault(key, []).append((a, a + WIDTH))
        for key, spans in known.items():
            for a, b in merged(spans):
                rows.append((key % n_shards, key, 0, 0, 0, None, a, b))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, clipped, count = {}, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, data = batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer())
                for code in sorted(set(batch.column(2)[i].as_py())):
                    sample, (least, most) = code >> 1, HALVES[code & 1]
                    lo = sample - most
                    first, end = max(0, -lo), min(WIDTH, len(data) - lo)
                    content = bytes(first) + bytes(data[lo + first : lo + end]) + bytes(WIDTH - end)
                    core = hashlib.blake2b(data[sample - least : sample - most + LENGTH], digest_size=8).digest()
                    shard = int.from_bytes(core, "big") % n_shards
                    if first or end < WIDTH:
                        clipped.append((shard, key, code, first, end, content, None, None))
                    else:
                        held.setdefault((shard, content), []).append((key, code))
                    count += 1
                    if len(held) + len(clipped) >= HELD or count >= 16 * HELD:
                        yield packed(held, clipped)
                        held, clipped, count = {}, [], 0
        yield packed(held, clipped)

    return run


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals in order, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def roomy_array(kind: type, *shape: int) -> np.ndarray:
    """Zeros in memory, or in an unnamed local file where they would take more than MEMORY."""
    if np.dtype(kind).itemsize * int(np.prod(shape)) <= MEMORY:
        return np.zeros(shape, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)  # noqa: SIM115


class Tuples:
    """A queue of (record, common prefix) in suffix order, bucketed by the byte that leads them.

    Bucket bounds come from the bytes' counts, so every push goes to its final place; large queues are mapped files.
    """

    def __init__(self, n: int, counts: np.ndarray):
        self.n = n
        self.next = np.cumsum(counts) - counts
        self.last = self.next.copy()
        #: least common prefix since the byte's last tuple; -1: no tuple yet
        self.least = np.full(256, -1, np.int16)
        self.record, self.common = roomy_array(np.uint32, n), roomy_array(np.uint8, n)

    def push(self, lead: np.ndarray, record: np.ndarray, common: np.ndarray) -> None:
        """Add a slice of the queue below, in its order: `lead` is the byte before each suffix."""
        order = np.argsort(lead, kind="stable")
        byte = lead[order]
        m = len(byte)
        head = np.append(True, byte[1:] != byte[:-1])
        heads = np.flatnonzero(head)
        present = byte[heads]
        sizes = np.diff(np.append(heads, m))
        # least common prefix between tuples of one byte, over what lies between them in the slice
        table = [common]
        while 1 << len(table) <= m:
            below, step = table[-1], 1 << len(table) - 1
            table.append(np.minimum(below[:-step], below[step:]))
        low, high = np.empty(m, np.int64), order + 1
        low[1:] = order[:-1] + 1
        low[heads] = 0  # the first of a byte: from the slice's start, then what was carried
        level = np.frexp(high - low)[1] - 1
        least = np.empty(m, np.int16)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k)])
        carried = self.least[present]
        least[heads] = np.where(carried < 0, -1, np.minimum(least[heads], carried))
        place = np.repeat(self.next[present] - heads, sizes) + np.arange(m)
        self.record[place] = record[order]
        self.common[place] = np.minimum(least + 1, LENGTH)
        self.next[present] += sizes
        # carry: absent bytes see the whole slice, present ones what follows their last tuple
        tail = np.minimum.accumulate(common[::-1])[::-1]
        self.least = np.where(self.least < 0, self.least, np.minimum(self.least, int(tail[0])))
        after = order[heads + sizes - 1] + 1
        self.least[present] = np.where(after < m, tail[np.minimum(after, m - 1)], 255)


def repeated_windows(content: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, records) of the windows that start at an offset of the records' bytes and occur more than once."""
    n = len(content)
    queue = Tuples(n, np.bincount(np.zeros(0, np.int64), minlength=256))
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        queue.record[a:b], queue.common[a:b] = np.arange(a, b), 0
    for offset in range(content.shape[1] - 1, -1, -1):
        counts = np.zeros(256, np.int64)
        for a in range(0, n, SLICE):
            counts += np.bincount(content[a : a + SLICE, offset], minlength=256)
        above = Tuples(n, counts)
        for a in range(0, n, SLICE):
            record = np.asarray(queue.record[a : a + SLICE])
            above.push(content[record, offset], record, np.asarray(queue.common[a : a + SLICE]))
        queue = above
        if offset + LENGTH <= content.shape[1]:
            yield from ((offset, x) for x in _runs(queue, offset, first, end))


def _runs(queue: Tuples, offset: int, first: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """Records in runs of full common prefixes, those whose window exists, where there are two of them."""
    pending = np.zeros(0, np.int64)  # the run that a slice leaves open
    for a in range(0, queue.n, SLICE):
        record, common = np.asarray(queue.record[a : a + SLICE]).astype(np.int64), np.asarray(queue.common[a : a + SLICE])
        fits = (first[record] <= offset) & (offset + LENGTH <= end[record])
        run = np.cumsum(common < LENGTH)  # 0: the open run goes on
        run, kept = np.append(np.zeros(len(pending), np.int64), run[fits]), np.append(pending, record[fits])
        last = int((common < LENGTH).sum())
        closed = run < last
        sizes = np.bincount(run[closed], minlength=1)
        yield kept[closed][sizes[run[closed]] > 1]
        pending = kept[~closed]
        if len(pending) > 2 * SLICE:  # long runs are let go in parts; two stay, so that a later one is not alone
            yield pending[:-2]
            pending = pending[-2:]
    if len(pending) > 1:
        yield pending


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed intervals (text, from, to): those that came known, then those found in each shard of the sorted partition."""
    known: list[pa.RecordBatch] = []

    def kept_aside() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = batch.filter(batch.column(5).is_null())
            if ready.num_rows:
                known.append(ready.select(["text_key", "a", "b"]))
            yield batch

    for _, (spool, keys, codes, first, end) in _spooled(kept_aside()):
        yield from known
        known.clear()
        found = roomy_array(bool, len(keys), HALF + 1)  # window starts by record
        for offset, records in repeated_windows(spool.bytes(), first, end):
            found[records, offset] = True
        for at in range(0, len(keys), SLICE):
            edge = np.diff(np.pad(np.asarray(found[at : at + SLICE]), ((0, 0), (1, 1))).astype(np.int8), axis=1)
            record, start = np.nonzero(edge == 1)
            stop = np.nonzero(edge == -1)[1]
            record += at
            base = (codes[record] >> 1) - np.array([h[1] for h in HALVES])[codes[record] & 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[record]), pa.array(base + start), pa.array(base + stop - 1 + LENGTH)], names=["text_key", "a", "b"])
    yield from known


class Spool:
    """Record bytes of one shard, in memory while they are few, else in an unnamed local file."""

    def __init__(self):
        self.file, self.size = tempfile.SpooledTemporaryFile(max_size=MEMORY), 0  # noqa: SIM115

    def add(self, column: pa.Array) -> None:
        for piece in column:
            self.file.write(piece.as_buffer())
        self.size += len(column) * WIDTH

    def bytes(self) -> np.ndarray:
        if self.size > MEMORY:
            self.file.flush()
            return np.memmap(self.file, np.uint8, "r", shape=(self.size // WIDTH, WIDTH))
        self.file.seek(0)
        return np.frombuffer(self.file.read(), np.uint8).reshape(-1, WIDTH)


def _spooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[Spool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    shard, spool, parts = None, Spool(), []

    def done():
        return shard, (spool, *(np.concatenate([p[i] for p in parts]) for i in range(4)))

    for batch in batches:
        batch = batch.filter(batch.column(5).is_valid())
        codes = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if parts and codes[a] != shard:
                yield done()
                spool, parts = Spool(), []
            shard = codes[a]
            part = batch.slice(a, b - a)
            spool.add(part.column(5))
            parts.append(tuple(part.column(i).to_numpy().copy() for i in (1, 2, 3, 4)))
    if parts:
        yield done()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes, removed bytes, spans, digest of the rest) from (id, text, intervals)."""
    for batch in batches:
        column, spans = batch.column(1), batch.column(2)
        out: list[tuple[int, int, int, str]] = []
        for i in range(batch.num_rows):
            data = memoryview(column[i].as_buffer()) if column[i].is_valid else memoryview(b"")
            gone = merged([(s["a"], s["b"]) for s in spans[i].as_py()]) if spans[i].is_valid else []
            rest, at = hashlib.sha256(), 0
            for a, b in gone:
                rest.update(data[at:a])
                at = b
            rest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in gone), len(gone), rest.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(text_key, spans): the removed intervals of every text that has any; text_key is the text's xxhash64."""
    texts = documents.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    long = texts.where(F.octet_length("_text") >= LENGTH)
    copies = long.groupBy("text_key").agg(F.count("*").alias("n"), F.max(F.octet_length("_text")).alias("size"))
    total = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = max(1, -(-int(total) * 3 // (SPAN * BUCKET)))  # about three cores a window length
    blobs = long.mapInArrow(_core_blobs(n_buckets), "bucket long, cores binary, codes binary, place binary, texts binary")
    codes = stored(blobs.groupBy("bucket").applyInArrow(_repeated, "text_key long, codes array<long>"), "cores")
    n_records = codes.agg(F.sum(F.size("codes"))).first()[0] or 0
    n_shards = max(1, -(-int(n_records) // SHARD))
    wanted = codes.groupBy("text_key").agg(F.flatten(F.collect_list("codes")).alias("codes"))
    # one row of each text; copies of it are left to adaptive splitting
    marked = documents.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text")).where(F.octet_length("_text") >= LENGTH)
    found = marked.join(wanted, "text_key").select("text_key", F.col("_text").cast("binary").alias("_text"), "codes")
    records = found.mapInArrow(_fresh(_records(n_shards)), RECORD)
    sorted_records = records.repartition("shard").sortWithinPartitions("shard")
    intervals = sorted_records.mapInArrow(_sorted_shard, "text_key long, a long, b long")
    whole = copies.where("n > 1").select("text_key", F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    return stored(intervals.union(whole).groupBy("text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def _fresh(run):
    """Pass each text of a partition on once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [k not in seen and not seen.add(k) for k in batch.column(0).to_pylist()]
            if any(new):
                yield from run(iter([batch.filter(pa.array(new))]))

    return once


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    spans = repeated_spans(documents, text_col=text_col)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.xxhash64(text_col).alias("text_key"))
    joined = rows.join(spans, "text_key", "left").select("_id", "_text", "spans")
    return joined.mapInArrow(_removed, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)
