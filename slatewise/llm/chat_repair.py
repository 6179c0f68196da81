"""Chat formatting: minimum-cost role repair by dynamic programming over the automaton of legal turns.

Legal: an optional system turn first, then user and assistant in turn, ending with assistant.  Every input turn is
either an output turn of some role (relabelled at a cost if that is not its own), preceded by empty turns where the
automaton asks for them, or merged into the output turn before it.  The cheapest sequence is rendered.

Cost of a step depends only on the state before it, so a stretch of turns acts as a 4 x 4 matrix of costs.
Turns are range-partitioned by (conversation, turn, role, text), so a conversation of any length spreads over
tasks; where one spans partitions, the matrices of its stretches are chained, a number bounded by the number of
partitions, and every stretch is then decoded between its two states.  Text is rendered as one fragment per
input turn; a conversation's fragments in order are its rendered text, and no task concatenates a conversation.

Defined cases: equal turn numbers follow role, then text; null turns come first; a null or unknown role is relabelled; null
texts are empty; repeated rows are turns like others; null conversation ids are one conversation.  Of equally
cheap repairs the one with least action weight wins, then the lower state.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.text import groups
from slatewise.session import stored

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3  # costs
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

#: Empty turns needed before a turn of a role (column) after a state (row); None: impossible.
BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
INFINITE = (1 << 62, 0, 0)


def _moves(own: int) -> list[tuple[int, int, tuple[int, int, int], str, tuple[int, ...]]]:
    """(from, to, (cost, weight, turns made), action, empty turns before) for a turn of role `own` (0: unknown)."""
    out = []
    for (before, role), empty in BETWEEN.items():
        wrong = role != own
        out.append((before, role, (INSERT * len(empty) + RELABEL * wrong, 2 * wrong + len(empty), 1 + len(empty)), "relabel" if wrong else "keep", empty))
    for state in (SYSTEM, USER, ASSISTANT):
        wrong = state != own
        out.append((state, state, (MERGE + RELABEL * wrong, 1 + 2 * wrong, 0), "merge", ()))
    return sorted(out, key=lambda x: (x[1], x[0]))


MOVES = [_moves(own) for own in range(4)]


def role_of(name: str | None) -> int:
    return ROLES.index(name) if name in ROLES[1:] else START


def _plus(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def forward(roles: list[int], entry: int) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int] | None]]]:
    """Best (cost, weight, turns) of every state after the turns, and for each turn how each state was reached."""
    best = [INFINITE] * 4
    best[entry] = (0, 0, 0)
    back: list[list[tuple[int, int] | None]] = []
    for own in roles:
        new, how = [INFINITE] * 4, [None] * 4
        for k, (before, after, cost, _, _) in enumerate(MOVES[own]):
            if best[before] < INFINITE:
                total = _plus(best[before], cost)
                if total < new[after]:
                    new[after], how[after] = total, (before, k)
        best = new
        back.append(how)
    return best, back


def finish(best: list[tuple[int, int, int]]) -> tuple[int, tuple[int, int, int]]:
    """(last state, total) with the empty turns that close the conversation."""
    totals = [_plus(b, (INSERT * len(CLOSING[s]), len(CLOSING[s]), len(CLOSING[s]))) if b < INFINITE else INFINITE for s, b in enumerate(best)]
    last = min(range(4), key=lambda s: (totals[s], s))
    return last, totals[last]


def decode(roles: list[int], entry: int, last: int | None) -> tuple[list[tuple[int, str, tuple[int, ...], int]], int]:
    """(state, action, empty turns before, cost) of every turn, and the state reached; last None: close the conversation."""
    best, back = forward(roles, entry)
    state = finish(best)[0] if last is None else last
    end, out = state, []
    for how, own in zip(reversed(back), reversed(roles), strict=True):
        before, k = how[state]
        out.append((state, MOVES[own][k][3], MOVES[own][k][4], MOVES[own][k][2][0]))
        state = before
    return out[::-1], end


def _empty(role: int) -> str:
    return OPEN.format(ROLES[role]) + CLOSE


def fragments(texts: list[str | None], path: list[tuple[int, str, tuple[int, ...], int]], first: bool, closing: tuple[int, ...] | None) -> list[str]:
    """Rendered text by turn; `first`: nothing was rendered before; `closing`: empty turns at the end, None: it goes on."""
    out, open_turn = [], not first
    for text, (state, action, empty, _) in zip(texts, path, strict=True):
        if action == "merge":
            out.append("\n" + (text or ""))
        else:
            out.append(CLOSE * open_turn + "".join(map(_empty, empty)) + OPEN.format(ROLES[state]) + (text or ""))
            open_turn = True
    if closing is not None and out:
        out[-1] += CLOSE + "".join(map(_empty, closing))
    return out


COLUMNS = "conversation string, turn long, role string, text string"


def repair(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input turn: (conv, turn, place, role, new_role, action, inserted, out_turn, cost, fragment).

    `place` numbers a conversation's rows within one partition's stretch, `stretch` the stretches; ordered by
    both, the fragments are the rendered conversation.  `inserted` counts empty turns put in before
    the row, and after it where the conversation ends.  `out_turn` is the place of the row's text in the output.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(F.coalesce(F.concat(F.lit("#"), F.col(conv_col).cast("string")), F.lit("")).alias("conversation"), F.col(conv_col).alias("_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = ["conversation", "turn", "role", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("stretch", F.spark_partition_id().cast("long"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())], names=[*batch.schema.names, "place"])
            at += batch.num_rows

    schema = f"conversation string, _id {kind}, turn long, role string, text string, stretch long, place long"
    ordered = stored(dealt.mapInArrow(numbered, schema), "turns")
    plan = _chained(ordered)
    spark = conversations.sparkSession
    # two rows for each partition at most
    known = spark.createDataFrame(plan, "conversation string, stretch long, entry int, last int, before long, first boolean, final boolean")
    ready = ordered.join(F.broadcast(known), ["conversation", "stretch"], "left").repartition("stretch").sortWithinPartitions("stretch", "place")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stretch in groups(batches, "stretch"):
            for _, table in groups(iter(stretch.combine_chunks().to_batches()), "conversation"):
                data = table.select(["role", "text", "entry", "last", "before", "first", "final"]).to_pydict()
                spans = data["entry"][0] is not None
                entry, last = (data["entry"][0], None if data["final"][0] else data["last"][0]) if spans else (START, None)
                final, before = data["final"][0] if spans else True, data["before"][0] if spans else 0
                path, end = decode([role_of(r) for r in data["role"]], entry, last)
                closing = CLOSING[end] if final else None
                parts = fragments(data["text"], path, data["first"][0] if spans else True, closing)
                inserted = [len(p[2]) for p in path]
                cost = [p[3] for p in path]
                if closing:
                    inserted[-1] += len(closing)
                    cost[-1] += INSERT * len(closing)
                place, out_turn = before, []
                for _, action, empty, _ in path:
                    place += 0 if action == "merge" else 1 + len(empty)
                    out_turn.append(place - 1)
                yield pa.RecordBatch.from_arrays(
                    [*(_one(table[c]) for c in ("_id", "turn", "stretch", "place", "role")), pa.array([ROLES[p[0]] for p in path]), pa.array([p[1] for p in path]), pa.array(inserted, pa.int32()), pa.array(out_turn, pa.int64()), pa.array(cost, pa.int32()), pa.array(parts, pa.string())],
                    names=["_id", "turn", "stretch", "place", "role", "new_role", "action", "inserted", "out_turn", "cost", "fragment"],
                )

    out = f"_id {kind}, turn long, stretch long, place long, role string, new_role string, action string, inserted int, out_turn long, cost int, fragment string"
    return ready.mapInArrow(rendered, out).withColumnRenamed("_id", conv_col)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _chained(ordered: DataFrame) -> list[tuple[str, int, int, int, int, bool, bool]]:
    """Entry and last state of every stretch of the conversations that span partitions."""
    pairs = ordered.select("conversation", "stretch").distinct()
    wide = pairs.groupBy("conversation").count().where("`count` > 1").select("conversation")
    if wide.isEmpty():
        return []
    mine = ordered.select("conversation", "stretch", "place", "role").join(F.broadcast(wide), "conversation")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stretch in groups(batches, "stretch"):
            for name, table in groups(iter(stretch.combine_chunks().to_batches()), "conversation"):
                roles = [role_of(r) for r in table["role"].to_pylist()]
                cells = [forward(roles, entry)[0] for entry in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), table["stretch"].slice(0, 1).combine_chunks(), pa.array([[v for row in cells for cell in row for v in cell]], pa.list_(pa.int64()))], names=["conversation", "stretch", "cells"])

    found = mine.repartition("stretch").sortWithinPartitions("stretch", "place").mapInArrow(matrices, "conversation string, stretch long, cells array<long>").collect()
    by_name = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["conversation"], r["stretch"])):
        c = r["cells"]
        by_name[r["conversation"]].append((r["stretch"], [[tuple(c[12 * e + 3 * s : 12 * e + 3 * s + 3]) for s in range(4)] for e in range(4)]))
    plan = []
    for name, stretches in by_name.items():
        best, back = [INFINITE] * 4, []
        best[START] = (0, 0, 0)
        for _, cells in stretches:
            new, how = [INFINITE] * 4, [None] * 4
            for e in range(4):
                for s in range(4):
                    if best[e] < INFINITE and cells[e][s] < INFINITE:
                        total = _plus(best[e], cells[e][s])
                        if total < new[s]:
                            new[s], how[s] = total, e
            best = new
            back.append(how)
        state = finish(best)[0]
        states = [state]
        for how in reversed(back):
            state = how[state]
            states.append(state)
        states.reverse()
        before = 0
        for k, (stretch, cells) in enumerate(stretches):
            plan.append((name, stretch, states[k], states[k + 1], before, k == 0, k == len(stretches) - 1))
            before += cells[states[k]][states[k + 1]][2]
    return plan
