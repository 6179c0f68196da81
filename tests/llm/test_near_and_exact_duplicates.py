"""Prefix-tree join and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.llm import components, prefix_tree_join, suffix_dedup
from slatewise.llm.prefix_tree_join import PrefixTree, link_documents, tree_links, window_size
from slatewise.llm.suffix_dedup import LENGTH, remove_repeats, repeated_windows

SCHEMA = "doc_id long, text string, extra string, node long, comp long"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(words, rate, rng):
    return [rng.choice("xyzuvw") + str(rng.randrange(999)) if rng.random() < rate else w for w in words]


def corpus(seed=5):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = edited(base, rng.choice([0, 0.005, 0.02, 0.06]), rng)
            rows.append((len(rows), " ".join(words + (passage if family % 2 else []))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t\n", "One two", "one TWO", "one", "É é a b c", "é É a b c", "a b c d e a b c d e a b c d e"])]
    rows += [(3, rows[3][1]), (None, rows[0][1]), (None, "a text of nobody that links with nothing")]
    return rows


@pytest.mark.parametrize(("block", "rows_a_set"), [(1024, 16), (4, 16), (4, 0)])
def test_components_equal_brute_force(spark, monkeypatch, block, rows_a_set):
    """Small blocks run the steps for large families, no rows a set the comparison of ways; all must be exact."""
    monkeypatch.setattr(prefix_tree_join, "BLOCK", block)
    monkeypatch.setattr(prefix_tree_join, "ROWS_A_SET", rows_a_set)
    rows = corpus()
    frame = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA)
    got = sorted((tuple(r) for r in link_documents(frame).collect()), key=repr)
    assert got == brute_components(rows)


def test_a_large_family_of_separate_pairs(spark):
    """More than BLOCK sets that share a passage and link in pairs only: nearly all are outside the main component."""
    passage = " ".join(f"p{i}" for i in range(30))
    own = [" ".join(f"w{pair}x{i}" for i in range(15)) for pair in range(1300)]
    rows = [(2 * pair + side, f"{passage} {own[pair]}" + " end" * side) for pair in range(len(own)) for side in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) > 2 * prefix_tree_join.BLOCK and got == {doc: doc - doc % 2 for doc, _ in rows}


def test_whole_sets_move_once_and_later_only_those_of_large_families(spark, monkeypatch):
    """The first round reads sets beside their blocks, without a join; later rounds read large families by a pushed filter."""
    plans, plain = [], prefix_tree_join.stored

    def spy(frame, label):
        plans.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return plain(frame, label)

    monkeypatch.setattr(prefix_tree_join, "stored", spy)
    monkeypatch.setattr(prefix_tree_join, "BLOCK", 4)
    rows = corpus()
    prefix_tree_join.keep_one(spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA)).collect()
    first, *later = [plan for label, plan in plans if label == "links"]
    assert "Join" not in first and len(later) == 2
    assert all("packed" in plan and "EqualTo(large,true)" in plan for plan in later)
    assert "stays" in [label for label, _ in plans]


def test_no_set_is_on_both_sides_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(prefix_tree_join, "BLOCK", 8)
    members = spark.range(0, 120, 2).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("comp"))
    grouped = prefix_tree_join._across(members).collect()
    assert len(grouped) == len({(r["group"], r["node"]) for r in grouped})
    block = {r["node"]: r["b"] for r in members.withColumn("n", F.lit(8).cast("long")).select("node", prefix_tree_join._block(7, "n").alias("b")).collect()}
    held, asks = ({(r["group"], r["node"]) for r in grouped if r["side"] == side} for side in (0, 1))
    by_group = {}
    for group, node in held:
        by_group.setdefault(group, set()).add(node)
    met = {(a, b) for group, a in asks for b in by_group.get(group, ())}
    main = max(block)
    assert all((a, b) in met for a in block for b in block if a != main and block[a] != block[b])


def test_keep_one_keeps_the_smallest_and_all_columns(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "other words stand in this one"), (None, "a b c d e f"), (7, None), (8, "")]
    kept = prefix_tree_join.keep_one(spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "extra", "node", "comp"]
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 2), (False, 7), (False, 8), (False, 9), (True, 0)]


def test_keep_one_decides_by_id_and_text(spark):
    """Texts of one id are decided each by itself; of rows without an id one of each component stays."""
    base = [f"w{i}" for i in range(40)]
    near = " ".join([*base[:-1], "other"])
    rows = [(1, "one text of the id"), (1, "quite another text of it"), (1, "one text of the id"), (2, " ".join(base)), (3, near), (3, "a clean text beside the linked one"), (4, " ".join(base)), (4, near)]
    rows += [(None, "nobody owns these six words"), (None, "nobody owns these six words"), (None, "a text of its own without id"), (None, None), (None, None), (6, ""), (6, ""), (7, near + " x"), (7, near + " y")]
    kept = prefix_tree_join.keep_one(spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA))
    want = [(1, "one text of the id"), (1, "quite another text of it"), (2, " ".join(base)), (3, "a clean text beside the linked one"), (None, "nobody owns these six words"), (None, "a text of its own without id"), (None, None), (None, None), (6, "")]
    assert sorted(map(repr, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(repr, want))
    two = prefix_tree_join.keep_one(spark.createDataFrame([(5, " ".join(base), "x", 1, 2), (5, near, "x", 1, 2)], SCHEMA))
    assert two.count() == 1


def test_keep_one_carries_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 77, 5, 6, 7), (2, "a b c d e f", 78, 5, 6, 7), (3, "g h i j k l", 79, 5, 6, 7), (3, "g h i j k l", 79, 5, 6, 7)]
    kept = prefix_tree_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _id int, _text_hash int, `_gone_id` int, `a.b` int"))
    assert kept.columns == ["doc_id", "text", "_id", "_text_hash", "_gone_id", "a.b"]
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert link_documents(empty).collect() == [] and prefix_tree_join.keep_one(empty).collect() == []
    assert remove_repeats(empty).collect() == []


def test_tree_search_finds_every_pair():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 5000, 300, dtype=np.uint64))
    sets = [np.unique(np.append(rng.choice(base, rng.integers(20, len(base)), replace=False), rng.integers(0, 9000, 20, dtype=np.uint64))) for _ in range(60)]
    sets += [sets[0][:-1], sets[0][:5], np.array([7], np.uint64)]
    tree = PrefixTree(sets)
    found = {(i, leaf) for leaf, queries in tree.search(tree.sets, lambda lo, hi, live: np.zeros(len(live), bool)) for i in queries.tolist()}
    assert found == {(i, j) for i, a in enumerate(tree.sets) for j, b in enumerate(tree.sets) if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    nodes = list(range(len(sets)))
    assert tree_links(nodes[:1], sets[:1], [0], [0]) == []
    assert tree_links([5, 6], [sets[0], sets[0][:-1]], [5, 6], [0, 1]) == [(5, 6)]


@pytest.mark.parametrize("task_edges", [1_000_000, 20])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rng = random.Random(1)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    top = {x: x for p in pairs for x in p}
    for _ in top:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == top
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_windows_hold_the_prefix():
    for n in range(1, 400):
        assert min(n, n // 4 + 1) <= window_size(n) <= n


def brute_removed(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + LENGTH] for _, b in data for s in range(len(b) - LENGTH + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if seen[b[s : s + LENGTH]] > 1:
                covered[s : s + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=repr)


def repeats():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage = text(260)
    rows = [(i, text(rng.randrange(0, 500)) + (passage if i % 3 == 0 else passage[:190] if i % 3 == 1 else "") + text(rng.randrange(0, 300))) for i in range(40)]
    exact = text(199)[:195] + "zzzzz"
    rows += [(40, "A" + exact), (41, exact + "B"), (42, exact[1:] + "CCC"), (43, "la " * 120), (44, "la " * 90), (45, "x" * 600), (46, None), (47, ""), (48, passage[:200]), (49, rows[0][1]), (49, rows[0][1]), (None, text(230)), (50, "y" * 199), (51, "y" * 199), (52, "\0" * 250)]
    return rows


def test_removed_bytes_equal_brute_force(spark):
    rows = repeats()
    frame = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], SCHEMA)
    assert sorted((tuple(r) for r in remove_repeats(frame).collect()), key=repr) == brute_removed(rows)


def test_shards_on_disk_and_in_slices(spark, monkeypatch):
    """Queues in mapped files and slices of a few tuples give the same result."""
    rng = np.random.default_rng(2)
    content = rng.integers(97, 99, (300, suffix_dedup.WIDTH), dtype=np.uint8)
    content[:, 40:270] = content[rng.integers(0, 6, 300)][:, 40:270]
    first, end = rng.integers(0, 50, 300).astype(np.int16), np.full(300, suffix_dedup.WIDTH, np.int16)

    def found():
        return sorted((o, r) for o, x in repeated_windows(content, first, end) for r in x.tolist())

    whole = found()
    monkeypatch.setattr(suffix_dedup, "SLICE", 7)
    monkeypatch.setattr(suffix_dedup, "MEMORY", 10)
    assert found() == whole and whole
    seen = Counter((o, content[r, o : o + LENGTH].tobytes()) for o in range(81) for r in range(300) if first[r] <= o)
    assert set(whole) == {(o, r) for o in range(81) for r in range(300) if first[r] <= o and seen[o, content[r, o : o + LENGTH].tobytes()] > 1}
