"""Language-model scores from a probabilistic suffix tree over words.

The tree's nodes are contexts: the empty one, single words, and runs of up to ``DEPTH`` words.  A context that occurs
``MIN_CONTEXT`` times in training texts is a candidate; it is retained, with its parent (the context without its first
word), where a divergence test favours it.  The test is the summed log ratio, over the context's training tokens,
of the next word's probability there to that of its parent, each token left out of the counts that predict it:
the context's count times the divergence of its distribution from its parent's, free of the gain of having seen itself.

A token is scored by the longest retained context that precedes it in its document.  Distributions are smoothed by
the parent's, P(w | s) = (c(s w) + MU P(w | parent)) / (c(s) + MU), down to the empty context's (c(w) + 1) / (N + V + 1),
which leaves one share for all unseen words: every distribution sums to one.

Documents lie in units of a written table, as numbers into the unit's vocabulary of 64-bit word fingerprints, dealt into
buckets by unit, so that the later passes over them shuffle nothing of them.  Counts of words, pairs and triples come
from an exchange (``exchange.py``) in which a unit sends its distinct fingerprints and gets back what other units add, in the
same order; all answers are dealt once into the units' buckets.  Test sums travel the same way, as whole numbers, and come back
as marks, so that neither the layout of units nor the order of tasks changes the tree.  No list of the whole corpus meets in one place.

Defined cases: null or blank texts are an end token alone; rows with a null id are training rows; repeated rows count
again and are scored each; ids keep their type.  Without training rows every token is unknown and N and V are 0.  An empty
table gives no rows.  Extra columns are ignored.  A context never reaches into another document.  Fingerprints of 64
bits stand for words; longer runs and contexts keep as many bits as their number asks for, so that one shares its counts
with another by a chance of at most 2^-``SHARING_BITS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm import exchange
from slatewise.llm import text as T
from slatewise.session import stored, work_path

DEPTH = 2
MIN_CONTEXT = 16
MU = 100.0
GAIN = 12.0  # natural-log units a context must win on its own training tokens
UNIT_TOKENS = 2 << 20
SHARING_BITS = 14
FINE = 1 << 6  # test sums are counted in these parts of a unit
END = T.mix64(np.array([0x656E64], np.uint64))
_JOIN = T._PLACE

def _units_arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("unit", pa.int64()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token numbers of about ``UNIT_TOKENS`` tokens a row; each document ends with the end token."""
    made = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def flush() -> pa.RecordBatch:
        nonlocal made
        prints, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        words, tokens = np.unique(prints, return_inverse=True)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        ids, marks = (pa.concat_arrays([h[i] for h in held]) for i in (2, 3))
        row = [pa.array([made]), one(ids), one(marks), one(pa.array(sizes.astype(np.int32))), pa.array([len(prints)]), pa.array([exchange.pack(words, ordered=True)], pa.binary()), pa.array([exchange.pack(tokens)], pa.binary())]
        made += 1
        held.clear()
        return pa.record_batch(row, schema=_units_arrow(ids.type))

    for batch in batches:
        for a, b, data, offsets in T.blocks(batch.column(2)):
            prints, bounds = T.words(data, offsets)
            held.append((np.insert(prints, bounds[1:], END[0]), np.diff(bounds) + 1, batch.column(0)[a:b], batch.column(1)[a:b]))
            if sum(len(h[0]) for h in held) >= UNIT_TOKENS:
                yield flush()
    if held:
        yield flush()


def _bucketed(rows: DataFrame, buckets: int, label: str = "token-units") -> DataFrame:
    """Rows of units as a written table dealt into buckets by unit: joins on the unit leave it where it lies."""
    spark = rows.sparkSession
    path = work_path(spark, label)
    name = f"{label.replace('-', '_')}_{path[-32:]}"
    rows.write.bucketBy(buckets, "unit").option("path", path).saveAsTable(name)
    return spark.table(name)


class Unit:
    """A unit's tokens: fingerprints of the runs that end at each, with the documents they lie in."""

    def __init__(self, row: dict, bits: int):
        self.keep = np.uint64((1 << 64) - (1 << (64 - bits)))
        words = exchange.unpack(row["words"], ordered=True)
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words, self.tokens = words, exchange.unpack(row["tokens"]).view(np.int64)
        self.runs = [words[self.tokens]]
        self.trains = np.repeat(~np.array(row["held"], bool), self.sizes)
        self.place = np.arange(len(self.runs[0])) - np.repeat(self.first, self.sizes)

    def run(self, n: int) -> np.ndarray:
        """Fingerprints of the n words that end at each token; meaningless where the document is shorter."""
        while len(self.runs) < n:
            k = len(self.runs)
            longer = np.zeros(len(self.runs[0]), np.uint64)
            longer[k:] = T.mix64(self.runs[-1][:-1] * _JOIN[1] + self.runs[0][1:] * _JOIN[0] + np.uint64(k))[k - 1 :] & self.keep
            self.runs.append(longer)
        return self.runs[n - 1]

    def distinct(self, n: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct runs of n words of the asked tokens, the place of each among them); all tokens ask for single words."""
        return (self.words, self.tokens) if n == 1 else np.unique(self.run(n)[asked], return_inverse=True)

    def context(self, n: int) -> np.ndarray:
        """Fingerprints of the n words before each token."""
        return np.append(np.zeros(1, np.uint64), self.run(n)[:-1] & self.keep)


def _counted(units: DataFrame, n: int, bits: int, n_ranges: int) -> DataFrame:
    """What other units add to runs of n words, and how many distinct ones of each range were trained."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, bits)
                long = unit.place >= n - 1
                prints, place = unit.distinct(n, long)
                amounts = np.bincount(place[unit.trains[long]], minlength=len(prints)).astype(np.int64)
                yield from exchange.batches(exchange.sending(row["unit"], prints, amounts, n_ranges), exchange.SENT_ARROW)

    sent = units.select("unit", "held", "sizes", "n", "words", "tokens").mapInArrow(send, exchange.SENT)
    return stored(exchange.others(sent, lambda prints, totals: np.array([(totals > 0).sum()])).withColumn("words", F.lit(n)), f"runs-of-{n}")


class Model:
    """Counts and retained contexts as one unit needs them."""

    def __init__(self, unit: Unit, answers: pa.Table, depth: int, n_train: int, n_words: int, mu: float, min_context: int):
        self.unit, self.depth, self.mu = unit, depth, mu

        def counts(n: int) -> np.ndarray:
            """Training totals of the runs of n words that end at each token; 0 where the document is shorter."""
            asked = unit.place >= n - 1
            known, place = unit.distinct(n, asked)
            own = np.bincount(place[unit.trains[asked]], minlength=len(known)).astype(np.int64)
            out = np.zeros(len(asked), np.int64)
            out[asked] = (own + exchange.in_order(answers.filter(pa.compute.equal(answers["words"], n))))[place]
            return out

        self.c = counts(1)
        self.root = (self.c + 1) / (n_train + n_words + 1)
        self.seen, self.runs, self.usable = [], [], []  # of the context of each depth, of context and token, whether a candidate
        usable, seen = np.ones(len(self.c), bool), self.c
        for d in range(1, self.depth + 1):
            before = np.append(0, seen[:-1])  # the run of d words that ends before the token
            usable = usable & (unit.place >= d) & (before >= min_context)
            seen = counts(d + 1)
            self.seen.append(before)
            self.runs.append(seen)
            self.usable.append(usable)

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, whole-number sums): the test of every candidate on the unit's training tokens; 0 where only asked for."""
        prints, sums = [], []
        below = self.root
        for d in range(1, self.depth + 1):
            ok = self.usable[d - 1]
            out = self.unit.trains.astype(np.int64)  # a training token is left out of its own counts
            better = (np.maximum(self.runs[d - 1] - out, 0) + self.mu * below) / (np.maximum(self.seen[d - 1] - out, 0) + self.mu)
            gain = np.where(self.unit.trains, np.rint(np.log(better / below) * FINE), 0).astype(np.int64)
            found, total = exchange.tally(self.unit.context(d)[ok], gain[ok])
            prints.append(found)
            sums.append(total)
            below = np.where(ok, better, below)
        return exchange.tally(np.concatenate(prints), np.concatenate(sums))

    def retained(self, marks: np.ndarray) -> np.ndarray:
        """The contexts whose tests are marked, of those that :meth:`gains` lists."""
        listed = np.unique(np.concatenate([self.unit.context(d)[self.usable[d - 1]] for d in range(1, self.depth + 1)]))
        return listed[marks > 0]

    def probabilities(self, kept: np.ndarray) -> np.ndarray:
        """Of every token, by its longest retained context."""
        p, on = self.root, np.ones(len(self.c), bool)
        for d in range(1, self.depth + 1):
            on = on & self.usable[d - 1] & exchange.lookup(kept, self.unit.context(d))[1]
            p = np.where(on, (self.runs[d - 1] + self.mu * p) / (self.seen[d - 1] + self.mu), p)
        return p


def score(
    documents: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_context: int = MIN_CONTEXT, mu: float = MU, gain: float = GAIN
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; a null ``held_out`` trains."""
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = _bucketed(rows.mapInArrow(_units, f"unit long, ids array<{id_type}>, held array<boolean>, sizes array<int>, n long, words binary, tokens binary"), buckets)
    n_train = units.select(F.explode(F.arrays_zip("held", "sizes")).alias("d")).where("not d.held").agg(F.coalesce(F.sum("d.sizes"), F.lit(0)).alias("n")).first()["n"]

    n_tokens = exchange.count_of(units, "n")
    n_ranges, bits = exchange.ranges_for(n_tokens), min(64, SHARING_BITS + ((depth + 1) * n_tokens).bit_length())
    levels = [_counted(units, n, bits, n_ranges) for n in range(1, depth + 2)]
    n_words = sum(int(exchange.unpack(bytes(r["amounts"])).view(np.int64)[0]) for r in levels[0].where("unit = -1").select("amounts").collect())  # one number a range
    answers = reduce(DataFrame.unionByName, levels).where("unit >= 0").select("unit", "range", "words", "amounts")
    answers = _bucketed(answers.repartition(buckets, "unit"), buckets, "unit-counts")
    least = int(gain * FINE)

    def made(unit: Unit, answered: pa.Table) -> Model:
        return Model(unit, answered, depth, n_train, n_words, mu, min_context)

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            out += exchange.sending(row["unit"], *made(Unit(row, bits), right).gains(), n_ranges)
        return pa.Table.from_batches([exchange.batch(out, exchange.SENT_ARROW)])

    numbers = units.select("unit", "held", "sizes", "words", "tokens")
    tested = numbers.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(test, exchange.SENT)
    marked = stored(exchange.marks(tested, lambda totals, own: totals >= least), "contexts")
    marked = marked.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("range", "amounts"))).alias("marks"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i, row in enumerate(left.select(["unit", "held", "sizes", "words", "tokens", "marks"]).to_pylist()):
            unit = Unit(row, bits)
            model = made(unit, right)
            marks = [exchange.unpack(m["amounts"]).view(np.int64) for m in row["marks"] or []]  # ranges in order, as they were sent
            kept = model.retained(np.concatenate([np.zeros(0, np.int64), *marks]))
            add = lambda values, unit=unit: np.add.reduceat(values, unit.first)
            columns = [left["ids"][i].values, pa.array(row["held"], pa.bool_()), pa.array(unit.sizes), pa.array(add((model.c > 0).astype(np.int64))), pa.array(np.full(len(unit.sizes), n_train)), pa.array(add(np.log10(model.root))), pa.array(add(np.log10(model.probabilities(kept))))]
            parts.append(pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(parts)

    out = f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole = units.select("unit", "ids", "held", "sizes", "words", "tokens").join(marked.hint("merge"), "unit", "left")
    return whole.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(scored, out)
