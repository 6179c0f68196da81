"""Phrase collocations of every language from Rabin-Karp fingerprints, verified against the text.

Texts are lower-cased and cut into pieces and words; a unit holds some megabytes of one language with single spaces
between words and a line feed between pieces.  Prefix polynomials over a unit's bytes (numpy, modulo 2^64) give the
fingerprint of every run of words by one subtraction.  A first exchange (``exchange.py``) adds up the occurrences of
equal fingerprints over all units; the units are the occurrence pointers.  Units whose text holds a fingerprint that
is frequent enough are answered, read every occurrence, compare its bytes with those of the first, and give the phrase
itself with its count: only frequent phrases become text.  Counts by text decide in the end, so two phrases of one
fingerprint cost a little work and no error.

Scores come from joins of phrases with their parts, in exact decimals.  No phrase or document is left out; the cut
after the first ``first`` phrases of a language is the report's.

Defined cases: null texts are empty; a null language counts under ``und``, as that language itself does; words and
phrases are compared byte by byte.  A repeated row counts again.  Very long texts are hashed in segments that overlap
by the words a phrase may need.  An empty table gives no rows.  Extra columns are ignored.  Counts of 10^15 or more
raise an error.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm import exchange
from slatewise.llm.text import _BYTE, _STEP, LOWER, mix64
from slatewise.session import stored

MIN_COUNT, MAX_WORDS, FIRST, CONTAINED_PCT = 10, 3, 2000, 50
UNIT_BYTES = 16 << 20
SEGMENT_BYTES = 1 << 20
KEPT_BITS = 56  # of a fingerprint
SCALE = 1_000_000
SHARES = 64  # of a language's phrases, ranked apart first

_TIDY = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else int(LOWER[b]) for b in range(256))
_SPACES, _BREAKS = re.compile(rb"  +"), re.compile(rb" *\n[ \n]*")
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
UNITS_ARROW = pa.schema([("unit", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
FOUND_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def tidy(text: bytes) -> bytes:
    """Lower-cased words with one space between them and a line feed between pieces."""
    return _BREAKS.sub(b"\n", _SPACES.sub(b" ", text.translate(_TIDY))).strip(b" \n")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    made = TaskContext.get().partitionId() << 32

    def flush(langs: list[str]) -> Iterator[tuple]:
        nonlocal made
        for lang in langs:
            data = b"\n".join(held.pop(lang))
            del sizes[lang]
            yield made, lang, data.count(b" ") + data.count(b"\n") + 1, len(data), pa.compress(data, "zstd", asbytes=True)
            made += 1

    for rows in batches:
        for text, lang in zip(rows.column(0), rows.column(1), strict=True):
            data = tidy((text.as_py() or "").encode())
            if data:
                lang = lang.as_py()
                held.setdefault(lang, []).append(data)
                sizes[lang] += len(data) + 1
                full = list(sizes) if sizes.total() >= 2 * UNIT_BYTES else [lang] if sizes[lang] >= UNIT_BYTES else []
                if full:
                    yield exchange.batch(list(flush(full)), UNITS_ARROW)
    if held:
        yield exchange.batch(list(flush(list(held))), UNITS_ARROW)


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_STEP, _BACK):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers = (made[0], made[1])
    return _powers


def segments(data: np.ndarray, words: int) -> Iterator[tuple[int, int, int]]:
    """(start, end of the words that belong here, end of the words that phrases need) over a unit."""
    gaps = np.flatnonzero((data == 32) | (data == 10))
    a = 0
    while a < len(data):
        k = int(np.searchsorted(gaps, a + SEGMENT_BYTES))
        if k >= len(gaps):
            yield a, len(data), len(data)
            return
        owned = int(gaps[k]) + 1
        yield a, owned, int(gaps[k + words - 1]) if k + words - 1 < len(gaps) else len(data)
        a = owned


def phrases(data: np.ndarray, max_words: int, salt: int, bits: int = KEPT_BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, fingerprints, starts, ends) of all runs of 1 to ``max_words`` words within pieces, segment by segment."""
    for a, owned, b in segments(data, max_words):
        part = data[a:b]
        forth, back = _power_tables(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * forth[: len(part)], out=prefix[1:])
        gap = (part == 32) | (part == 10)
        starts = np.flatnonzero(np.append(True, gap[:-1]) & ~gap)
        ends = np.append(np.flatnonzero(gap[1:] & ~gap[:-1]) + 1, len(part))[: len(starts)]
        piece = np.cumsum(part == 10)[starts]
        mine = int(np.searchsorted(starts, owned - a))
        for n in range(1, max_words + 1):
            last = np.arange(n - 1, len(starts))[:mine]
            first = last - n + 1
            whole = piece[first] == piece[last]
            s, e = starts[first[whole]], ends[last[whole]]
            prints = mix64((prefix[e] - prefix[s]) * back[s] + np.uint64(salt)) >> np.uint64(64 - bits) << np.uint64(64 - bits)
            yield n, prints, s + a, e + a


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _opened(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["data"], row["size"], "zstd", asbytes=True), np.uint8)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte positions of all runs, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _different(data: np.ndarray, starts: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which runs differ from the run of the same length at ``firsts``, a bounded number of bytes at a time."""
    out = np.zeros(len(starts), bool)
    for a in range(0, len(starts), 1 << 17):
        n = lengths[a : a + (1 << 17)]
        unlike = data[_places(starts[a : a + (1 << 17)], n)] != data[_places(firsts[a : a + (1 << 17)], n)]
        out[a : a + (1 << 17)] = np.add.reduceat(unlike, np.cumsum(n) - n) > 0
    return out


def verified(data: np.ndarray, wanted: np.ndarray, max_words: int, salt: int, bits: int = KEPT_BITS) -> Iterator[tuple[int, list[bytes] | np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, texts or none, starts, ends, counts): the phrases of a unit whose fingerprint is wanted, told apart by their bytes."""
    held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(max_words + 1)]
    for n, prints, s, e in phrases(data, max_words, salt, bits):
        hit = exchange.lookup(wanted, prints)[1]
        held[n].append((prints[hit], s[hit].astype(np.uint32), (e[hit] - s[hit]).astype(np.uint32)))
    for n in range(1, max_words + 1):
        prints, s, length = (np.concatenate([h[i] for h in held[n]]) if held[n] else np.zeros(0, np.uint64) for i in range(3))
        held[n] = []
        if not len(prints):
            continue
        order = np.argsort(prints, kind="stable").astype(np.uint32)
        prints, s, length = prints[order], s[order], length[order]
        del order
        opens = np.append(True, prints[1:] != prints[:-1])
        first = np.flatnonzero(opens)
        group = np.cumsum(opens, dtype=np.uint32) - np.uint32(1)
        odd = length != length[first[group]]
        for a in range(0, len(odd), 1 << 20):
            same = a + np.flatnonzero(~odd[a : a + (1 << 20)])
            odd[same] = _different(data, s[same].astype(np.int64), s[first[group[same]]].astype(np.int64), length[same].astype(np.int64))
        mixed = np.zeros(len(first), bool)
        mixed[group[odd]] = True
        counts = np.diff(np.append(first, len(prints)))
        begin, size = s[first[~mixed]].astype(np.int64), length[first[~mixed]].astype(np.int64)
        yield n, [], begin, begin + size, counts[~mixed]
        if mixed.any():
            apart = Counter(data[a : a + b].tobytes() for a, b in zip(s[mixed[group]].tolist(), length[mixed[group]].tolist(), strict=True))
            yield n, list(apart), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(list(apart.values()), np.int64)


def phrase_counts(units: DataFrame, min_count: int, max_words: int, bits: int = KEPT_BITS) -> DataFrame:
    """(lang, phrase, words, f): all runs of up to ``max_words`` words that occur ``min_count`` times in their language."""
    n_ranges = exchange.ranges_for(max_words * exchange.count_of(units, "n_words"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                tallies = []
                for _, p, _, _ in phrases(_opened(row), max_words, _salt(row["lang"]), bits):
                    found, counts = exchange.tally(p)
                    tallies.append((found, counts.astype(np.uint32)))
                yield from exchange.batches(exchange.sending_tallies(row["unit"], tallies, n_ranges), exchange.SENT_ARROW)

    frequent = exchange.answers(units.mapInArrow(send, exchange.SENT), lambda totals, own: totals >= min_count)

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = exchange.joined(right)
        parts = []
        for row in left.to_pylist() if len(wanted) else []:
            data = _opened(row)
            for n, texts, s, e, counts in verified(data, wanted, max_words, _salt(row["lang"]), bits):
                if len(s):
                    lengths = e - s
                    bytes_of = pa.py_buffer(np.ascontiguousarray(data[_places(s, lengths)]))
                    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), bytes_of]).cast(pa.large_string()).cast(pa.string())
                else:
                    texts = pa.array([t.decode() for t in texts], pa.string())
                parts.append(pa.table([pa.array([row["lang"]] * len(texts), pa.string()), texts, pa.array(np.full(len(texts), n, np.int32)), pa.array(counts)], schema=FOUND_ARROW))
        return pa.concat_tables(parts) if parts else FOUND_ARROW.empty_table()

    found = units.groupBy("unit").cogroup(frequent.groupBy("unit")).applyInArrow(read, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def collocations(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, first: int | None = FIRST, bits: int = KEPT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to ``max_words`` words by score."""
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    units = stored(texts.mapInArrow(_units, "unit long, lang string, n_words long, size long, data binary"), "phrase-units")
    counts = stored(phrase_counts(units, min_count, max_words, bits), "phrase-counts")
    words_of = units.groupBy("lang").agg(F.sum("n_words").alias("n"))

    word = F.split("phrase", " ")
    run = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    longer = counts.where("words > 1")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("*", run(F.lit(1), F.col("k")).alias("left_part"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right_part"))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(f"{side}_part"), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left_part"]).join(part("right", "r"), ["lang", "right_part"])
    exact = lambda c: f"cast({c} as decimal(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * {exact('f')} * {exact('f')}) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "phrase", "words", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = counts.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.select("lang", run(F.col("start"), F.col("size")).alias("phrase"), F.col("f").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around") * 100 < F.col("f") * CONTAINED_PCT, F.lit(True)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    found = kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    if first is not None:  # the first of each share of a language, so that no language meets whole in one task
        found = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("place", place("lang", "share")).where(F.col("place") <= first)
    ranked = found.withColumn("rank", place("lang"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(F.broadcast(words_of) if words_of.limit(10_001).count() <= 10_000 else words_of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
