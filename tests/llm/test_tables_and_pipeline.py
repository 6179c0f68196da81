"""Chat repair, slot sharding, exact top-k and the pipeline."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry
import corpus_pipeline
from slatewise.llm import chat_repair, maxscore, slot_sharding
from slatewise.llm.chat_repair import ASSISTANT, BETWEEN, CLOSING, INSERT, MERGE, RELABEL, START, SYSTEM, USER, repair, role_of

CHAT = "conv_id long, turn long, role string, text string, stretch string"


def brute_cost(roles):
    """Least cost over all choices of merge or role for every turn."""
    best = None
    for choice in itertools.product(("merge", SYSTEM, USER, ASSISTANT), repeat=len(roles)):
        state, cost = START, 0
        for pick, role in zip(choice, roles, strict=True):
            if pick == "merge":
                if state == START:
                    break
                cost += MERGE + RELABEL * (role != state)
            elif (state, pick) in BETWEEN:
                cost += INSERT * len(BETWEEN[state, pick]) + RELABEL * (role != pick)
                state = pick
            else:
                break
        else:
            cost += INSERT * len(CLOSING[state])
            best = cost if best is None else min(best, cost)
    return best


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest))


def rendered_roles(text):
    return [part.split("|>")[0] for part in text.split("<|") if part and not part.startswith("end")]


def test_repair_is_legal_and_cheapest(spark, monkeypatch):
    rng = random.Random(4)
    names = ["system", "user", "assistant", "tool", None]
    chats = {i: [rng.choice(names) for _ in range(rng.randrange(1, 6))] for i in range(40)} | {40: ["user", "assistant"], 41: ["system"], 42: ["assistant", "assistant"]}
    rows = [(i, k, r, f"t{k}" if k % 3 else None, "x") for i, roles in chats.items() for k, r in enumerate(roles)] + [(None, 0, "user", "nobody", "x")]
    got = repair(spark.createDataFrame(rows, CHAT)).toPandas().sort_values(["conv_id", "stretch", "place"])
    assert len(got) == len(rows)
    for i, roles in chats.items():
        mine = got[got.conv_id == i]
        text = "".join(mine.fragment)
        assert mine.cost.sum() == brute_cost([role_of(r) for r in roles]), roles
        assert legal(rendered_roles(text)) and text.count("<|end|>") == len(rendered_roles(text))
        kept = [n for n, a in zip(mine.out_turn, mine.action, strict=True) if a != "merge"]
        assert kept == sorted(set(kept))
    assert "".join(got[got.conv_id == 40].fragment) == "<|user|>\n<|end|>\n<|assistant|>\nt1<|end|>\n"
    assert repair(spark.createDataFrame([], CHAT)).collect() == []


def test_a_conversation_over_many_partitions(spark):
    """Stretches of one conversation in several tasks cost what one task finds."""
    rng = random.Random(9)
    roles = [rng.choice(["user", "assistant", "assistant", "tool", "system"]) for _ in range(3000)]
    frame = spark.createDataFrame([(7, k, r, str(k), "x") for k, r in enumerate(roles)], CHAT).union(spark.createDataFrame([(8, 0, "user", "hi", "x")], CHAT))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair(frame).toPandas().sort_values(["conv_id", "stretch", "place"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    mine = got[got.conv_id == 7]
    assert mine.stretch.nunique() > 1 and list(mine.turn) == list(range(3000))
    best, _ = chat_repair.forward([role_of(r) for r in roles], START)
    assert mine.cost.sum() == chat_repair.finish(best)[1][0]
    text = "".join(mine.fragment)
    assert legal(rendered_roles(text)) and text.count("<|end|>") == len(rendered_roles(text)) and text.endswith("<|end|>\n")
    assert mine.out_turn.is_monotonic_increasing


DOCS = "doc_id long, text string, shard string, slot string"


def test_shards_hold_all_rows_in_near_equal_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(900), "x", "y") for i in range(3000)] + [(5000, None, "x", "y"), (None, "nobody", "x", "y"), (1, "again", "x", "y"), (1, "again", "x", "y")] + [(6000 + i, "copy", "x", "y") for i in range(900)]
    got = slot_sharding.shard_records(spark, spark.createDataFrame(rows, DOCS)).toPandas()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == want
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(16)) and load.max() - load.min() < 0.02 * load.mean()
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert got.groupby("virtual_slot")["shard"].nunique().max() == 1 and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert slot_sharding.shard_records(spark, spark.createDataFrame([], DOCS)).collect() == []


def test_repeated_rows_keep_the_law(spark):
    rows = [(i, f"text {i} " * (i % 9), "x", "y") for i in range(4000)] + [(7, "the same row " * 20, "x", "y")] * 2000 + [(None, "no id", "x", "y")] * 300
    got = slot_sharding.shard_records(spark, spark.createDataFrame(rows, DOCS).repartition(3)).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and load.max() < 1.02 * load.mean() and len(load) == 16
    assert got.groupby("virtual_slot").size().max() < 20
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


def test_map_versions_move_few_slots(spark, tmp_path):
    records = slot_sharding.records_of(spark.createDataFrame([(i, "word " * (i % 50), "x", "y") for i in range(5000)], DOCS), slots=512)
    slots = slot_sharding.SlotMap(spark, str(tmp_path / "map"))
    first = {r["virtual_slot"]: (r["shard"], r["slot_bytes"]) for r in slots.create(records, 8).collect()}
    second = {r["virtual_slot"]: r["shard"] for r in slots.rebalance(1, records, 9).collect()}
    assert sum(second[s] != shard for s, (shard, _) in first.items()) < 0.14 * len(first)  # a ninth, and little more
    load = pd.Series({s: b for s, (_, b) in first.items()}).groupby(second).sum()
    assert len(load) == 9 and load.max() < 1.02 * load.mean()
    third = {r["virtual_slot"]: r["shard"] for r in slots.rebalance(2, records, 7).collect()}
    assert set(third.values()) == set(range(7))
    assert {r["virtual_slot"]: r["shard"] for r in slots.read(1).collect()} == {s: shard for s, (shard, _) in first.items()}
    moved = sum(third[s] != shard for s, shard in second.items() if shard < 7)
    assert moved < 0.1 * len(third)


def test_top_k_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(6)], "x") for i in range(400)]
    rows += [(450, rows[50][1], "x"), (451, rows[50][1], "x"), (500, None, "x"), (550, [None] * 6, "x"), (600, [float("nan")] * 6, "x"), (650, [float("inf")] * 6, "x"), (700, [], "x"), (None, [0.1] * 6, "x"), (750, [0.5] * 3, "x"), (751, [0.25] * 3, "x")]
    rows += [(50, rows[60][1], "x"), (50, rows[60][1], "x"), (800, [], "x"), (801, [3e5] * 6, "x"), (850, [-2e5] * 6, "x")]  # ids of several query rows, large components
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    frame.createOrReplaceTempView("unused")
    got = sorted(tuple(r) for r in maxscore.top_k(frame, frame.vec_id % 50 == 0).collect())
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [[a, b] for a, b, _ in rows])
    assert got == sorted(con.execute(entry.oracle_sql()["op9_maxscore"]).fetchall())
    assert maxscore.top_k(frame.limit(0), frame.vec_id % 50 == 0).collect() == []


def test_top_k_reads_fewer_components_than_there_are():
    """Terms of little spread are probed for vectors that still matter only; a threshold from elsewhere saves more."""
    rng = np.random.default_rng(9)
    vectors = np.floor(256 * rng.normal(size=(20_000, 64)) * 0.8 ** np.arange(64))
    seen = {}
    for name, seeded in (("alone", False), ("seeded", True)):
        shard = maxscore.Shard(np.arange(20_000), np.arange(20_000), vectors)
        for row in range(5):
            exact = vectors @ vectors[row]
            exact[row] = -np.inf
            want = np.lexsort((np.arange(20_000), -exact))[:5]
            at, found = shard.search(row, vectors[row], exact[want[-1]] if seeded else -np.inf, 5)
            assert at.tolist() == want.tolist() and found.tolist() == exact[want].astype(int).tolist()
        seen[name] = shard.probes
    whole = 5 * 20_000 * 64
    assert seen["seeded"] < seen["alone"] < 0.6 * whole and seen["seeded"] < 0.3 * whole


def test_pipeline_stages_take_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        sizes.append(docs.select("doc_id").distinct().count())
    assert sizes[0] > sizes[1] > sizes[2] and sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 100
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, docs.collect()))
