"""Collocations, the suffix-tree language model and hard negatives against plain versions of themselves."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.llm import collocations, exchange, hard_negatives, suffix_tree_lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = "doc_id long, text string, lang string, unit string, phrase string, n long, _row int, f int"


def prose(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))


def corpus(seed, rows=150):
    rng = random.Random(seed)
    words = ["The", "old", "New", "york", "é", "ÉT", "a\x00b", "x\x1f", "river", "bank"]
    made = [(i, prose(rng, words, rng.randrange(60)), rng.choice(["en", "de", None, "und"]), "u", "p", 1, 2, 3) for i in range(rows)]
    return made + [(None, None, None, "u", "p", 1, 2, 3), (900, "", "en", "u", "p", 1, 2, 3), (901, " .,\n ", "fr", "u", "p", 1, 2, 3), made[3], made[3]]


def plain_collocations(rows, min_count=10, max_words=3, first=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {key: c for key, c in f.items() if c >= min_count}
    out = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) > 1:
            around = [c for (other, longer), c in f.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
            if not any(100 * c >= 50 * a for c in around):
                cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
                score, _, left, right = min(cuts)
                out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:first]))


@pytest.mark.parametrize(("bits", "max_words", "first"), [(56, 3, 2000), (9, 3, 7), (56, 4, 2000)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, bits, max_words, first):
    """Fingerprints of nine bits collide all the time: the text decides."""
    rows = corpus(1)
    monkeypatch.setattr(collocations, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(collocations, "UNIT_BYTES", 500)
    monkeypatch.setattr(exchange, "RANGE_ENTRIES", 4000)
    got = collocations.collocations(spark.createDataFrame(rows, TEXTS).repartition(3), max_words=max_words, first=first, bits=bits).collect()
    want = plain_collocations(rows, max_words=max_words, first=first)
    assert len(want) > 20 and sorted(map(tuple, got)) == want


def test_collocations_of_a_long_text_and_of_none(spark):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice("abcdefgh") for _ in range(1_200_000)), "en", "u", "p", 1, 2, 3)]
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, TEXTS)).collect())) == plain_collocations(rows)
    assert collocations.collocations(spark.createDataFrame([], TEXTS)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 5 * 10**11, 7 * 10**11, 9 * 10**12
    exact = lambda c: f"cast({c} as decimal(15, 0))"
    assert spark.sql(f"select (1000000 * {exact(a)} * {exact(a)}) div ({exact(left)} * {exact(right)}) as s").first()["s"] == 10**6 * a * a // (left * right)


def plain_tree(rows, depth, min_context, mu, gain):
    """Scores by dictionaries of word tuples."""
    split = [([w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if w] + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    c = Counter()
    for words, held in split:
        if not held:
            for k in range(1, depth + 2):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    total, kinds = sum(v for k, v in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    root = lambda w: (c[(w,)] + 1) / (total + kinds + 1)
    gains = Counter()
    for words, held in split:
        for t, w in enumerate(words) if not held else ():
            below = root(w)
            for d in range(1, depth + 1):
                s = tuple(words[t - d : t]) if t >= d else None
                if s is None or c[s] < min_context:
                    break
                better = (c[s + (w,)] - 1 + mu * below) / (c[s] - 1 + mu)
                gains[s] += int(np.rint(np.log(better / below) * suffix_tree_lm.FINE))
                below = better
    out = []
    for words, held in split:
        base = score = 0.0
        for t, w in enumerate(words):
            p = root(w)
            base += math.log10(p)
            for d in range(1, depth + 1):
                s = tuple(words[t - d : t]) if t >= d else None
                if s is None or c[s] < min_context or gains[s] < gain * suffix_tree_lm.FINE:
                    break
                p = (c[s + (w,)] + mu * p) / (c[s] + mu)
            score += math.log10(p)
        out.append((held, len(words), sum(c[(w,)] > 0 for w in words), total, round(base, 6), round(score, 6)))
    return out, sum(g >= gain * suffix_tree_lm.FINE for g in gains.values())


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_scores_equal_plain_dictionaries(spark, monkeypatch, depth):
    rng = random.Random(3)
    rows = corpus(4, 120)
    for i in range(60):  # words that follow each other
        rows.append((300 + i, " ".join(rng.choice(["green tea leaf", "black tea pot", "tea"]) for _ in range(rng.randrange(1, 30))), "en", "u", "p", 1, 2, 3))
    monkeypatch.setattr(suffix_tree_lm, "UNIT_TOKENS", 300)
    monkeypatch.setattr(suffix_tree_lm, "SHARING_BITS", 30)
    monkeypatch.setattr(exchange, "RANGE_ENTRIES", 1000)
    got = suffix_tree_lm.score(spark.createDataFrame(rows, TEXTS).repartition(3), held(), depth=depth, min_context=5, mu=4.0, gain=2.0).collect()
    want, retained = plain_tree(rows, depth, 5, 4.0, 2.0)
    assert retained > 10
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    tidy = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(tidy, key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_suffix_tree_without_training_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = suffix_tree_lm.score(frame, F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert suffix_tree_lm.score(frame.limit(0), F.lit(False)).collect() == []


def plain_negatives(rows, k=5):
    kept = [(i, x, [math.floor(256 * a) for a in v]) for i, v, x, *_ in rows if i is not None and x is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)]
    out = []
    for at, (i, x, v) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, y) for other, (j, y, w) in enumerate(kept) if other != at and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == x][:k]:
            inside = [r for r in scored if r[2] != x and -80 * s <= -100 * r[0] <= -100 * s][:k]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(inside)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, _row int, dims int, score int"


@pytest.mark.parametrize("dims", [3, 64, 70])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    middle = rng.normal(size=(3, dims))
    rows = [(int(i), [float(np.float32(a)) for a in middle[i % 3] + 0.4 * rng.normal(size=dims)], int(rng.integers(3)), 1, 2, 3) for i in range(350)]
    rows += [rows[200], rows[200], (100, rows[7][1], 1, 1, 2, 3), (None, rows[5][1], 1, 1, 2, 3), (701, None, 1, 1, 2, 3), (702, rows[5][1], None, 1, 2, 3), (703, [None] * dims, 1, 1, 2, 3)]
    rows += [(704, [float("nan")] * dims, 1, 1, 2, 3), (705, [float("inf")] + [0.0] * (dims - 1), 1, 1, 2, 3), (800, [0.0] * dims, 1, 1, 2, 3), (801, [1.0] * (dims + 1), 1, 1, 2, 3), (900, [3e5] + [0.0] * (dims - 1), 1, 1, 2, 3), (901, [2e5] * dims, 0, 1, 2, 3)]
    rows += [(1000 + i, rows[9][1], i % 2, 1, 2, 3) for i in range(60)]  # copies
    monkeypatch.setattr(hard_negatives, "SHARD", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_intervals_hold_and_leave_vectors_out():
    rng = np.random.default_rng(8)
    ints = np.floor(256 * np.concatenate([rng.normal(size=(400, 64)), 0.5 * rng.normal(size=(30, 64)) + rng.normal(size=64), np.zeros((1, 64)), 1e12 * rng.normal(size=(5, 64))]))
    coded = hard_negatives.codes(ints)
    for anchor in (ints[0], ints[410], ints[430], ints[434]):
        seen = []
        everything = lambda low, high, seen=seen: seen.append((low, high)) or np.ones(len(low), bool)
        hard_negatives.narrowed(hard_negatives.Probe(anchor), *coded, np.arange(len(ints)), everything)
        exact = ints @ anchor
        assert len(seen) == hard_negatives.STAGES and all((low <= exact).all() and (exact <= high).all() for low, high in seen)
    left, _, _ = hard_negatives.narrowed(hard_negatives.Probe(ints[410]), *coded, np.arange(430), lambda low, high: high >= hard_negatives.kth_largest(low, 5))
    assert len(left) < 40 and set(np.argsort(-(ints[:430] @ ints[410]))[:5]) <= set(left)


def test_components_of_any_size():
    huge = np.array([[float(2**60), 3.0], [1.0, 1.0]])
    assert hard_negatives.scores(huge, np.array([4.0, 1.0])).tolist() == [4 * 2**60 + 3, 5]
    with pytest.raises(OverflowError):
        hard_negatives.scores(huge, np.array([16.0, 1.0]))


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0, F.col("label")).collect() == []


def test_packed_lists_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert (exchange.unpack(exchange.pack(values, ordered=True), ordered=True) == values).all()
        assert (exchange.unpack(exchange.pack(values - np.uint64(5))) == values - np.uint64(5)).all()


def test_sums_of_tallies_are_sent_range_by_range_without_sorting_the_whole():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 1 << 63, 400, np.uint64) << np.uint64(1) for _ in range(3)]
    lists.append(lists[0][:100])
    tallies = [exchange.tally(x) for x in lists]
    whole = exchange.tally(np.concatenate(lists))
    assert list(exchange.sending_tallies(7, tallies, 5)) == list(exchange.sending(7, *whole, 5))


def test_marks_come_back_in_the_order_sent_without_fingerprints(spark):
    sent = [(0, 1, [3, 5, 9], [4, 1, 2]), (0, 2, [5, 7], [9, 1]), (1, 1, [1 << 63], [12])]
    rows = [(r, u, exchange.pack(np.array(p, np.uint64), ordered=True), exchange.pack(np.array(a, np.int64))) for r, u, p, a in sent]
    found = exchange.marks(spark.createDataFrame(rows, exchange.SENT), lambda totals, own: totals >= 10)
    assert found.columns == ["range", "unit", "amounts"]
    got = {(r["range"], r["unit"]): exchange.unpack(bytes(r["amounts"])).tolist() for r in found.collect()}
    assert got == {(0, 1): [0, 1, 0], (0, 2): [1, 0], (1, 1): [1]}
