"""Hard negatives by rotated one-bit codes whose stored alignment gives certain score intervals.

Vectors become integers, floor(256 x).  A fixed random rotation turns each into signs, one bit a dimension; with the
code is stored the alignment, the inner product of the vector with its unit sign direction.  What the code leaves, the
residual, is orthogonal to that direction and coded again under another rotation, ``STAGES`` times in all; each code takes
about two thirds of what was left.  With alignments a_j and directions s_j an anchor q has

    <q, o> = a_1 <q, s_1> + ... + a_j <q, s_j> + <q, rest>,   rest orthogonal to s_j,

so Cauchy-Schwarz bounds the last term by |rest| sqrt(|q|^2 - <q, s_j>^2): a certain interval, not a likely one.
<q, s_j> comes from popcounts of the code against the bit planes of the rotated anchor, rounded to ``PLANES`` bits; the
length of what rounding lost widens the interval, again by Cauchy-Schwarz, and so does a slack for floating point.
After each code the vectors whose interval rules them out are left; later codes are read for the others only.

A block of anchors meets a shard of vectors in one task.  For positives, vectors of the anchor's label whose upper end
reaches the k-th best lower end survive; for negatives, vectors of another label whose interval meets the band of a
positive's score, and reaches the k-th best lower end of those certainly inside the band.  Survivors alone are scored, in
exact integers, and k for each anchor (or anchor and positive) leave the task.  The anchors grow with the table, as the
deal has it; tasks do not.

Defined cases: rows with a null id, null label, null vector, or any null or non-finite component take no part; empty
vectors score 0 with each other.  Only vectors of one length meet.  Rows are told apart as rows, so copies of an
anchor's row are others to it, and each of two anchors of one id is mined (their rows share the id).  Scores are exact for
components of any size; one that passes 64 bits raises an error.  Equal scores go by smaller id.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import stored

SHARD, ANCHOR_BLOCK = 32768, 512
STAGES = 6
PLANES = 8  # bits of a rotated anchor's component
SEED = 20_240_501
SLACK = 1e-9  # of |q||o|, for floating point
EXACT = 1 << 62

CODED = "_row long, _id long, _label int, _dims int, _ints array<double>, _codes array<binary>, _aligns array<double>, _rests array<double>"
CODED_ARROW = pa.schema([("_row", pa.int64()), ("_id", pa.int64()), ("_label", pa.int32()), ("_dims", pa.int32()), ("_ints", pa.list_(pa.float64())), ("_codes", pa.list_(pa.binary())), ("_aligns", pa.list_(pa.float64())), ("_rests", pa.list_(pa.float64()))])


@cache
def rotation(dims: int, stage: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, stage, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    n, dims = flags.shape
    padded = np.zeros((n, -(-max(dims, 1) // 64) * 64), np.uint8)
    padded[:, :dims] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def codes(ints: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sign words of each stage, alignments, lengths of the residual before and after each stage) of the rows of a matrix."""
    n, dims = ints.shape
    scale = np.maximum(np.abs(ints).max(1, initial=0.0), 1.0)[:, None]
    rest = ints / scale  # no overflow for huge components
    words, aligns, rests = [], np.zeros((n, STAGES)), np.zeros((n, STAGES + 1))
    rests[:, 0] = np.sqrt((rest * rest).sum(1))
    for stage in range(STAGES):
        turned = rest @ rotation(dims, stage)
        signs = np.where(turned > 0, 1.0, -1.0) / np.sqrt(max(dims, 1))
        words.append(bits(turned > 0))
        aligns[:, stage] = (turned * signs).sum(1)
        rest = rest - (aligns[:, stage, None] * signs) @ rotation(dims, stage).T
        rests[:, stage + 1] = np.sqrt((rest * rest).sum(1))
    return words, aligns * scale, rests * scale


class Probe:
    """An anchor, rotated and cut into bit planes for every stage."""

    def __init__(self, anchor: np.ndarray):
        self.dims = len(anchor)
        self.scale = max(float(np.abs(anchor).max(initial=0.0)), 1.0)
        self.stages = []
        for stage in range(STAGES):
            turned = (anchor / self.scale) @ rotation(self.dims, stage)
            low, high = float(turned.min(initial=0.0)), float(turned.max(initial=0.0))
            step = (high - low) / ((1 << PLANES) - 1) or 1.0
            levels = np.rint((turned - low) / step).astype(np.int64)
            planes = [bits((levels >> bit & 1)[None, :])[0] for bit in range(PLANES)]
            self.stages.append((low, step, int(levels.sum()), planes, float(np.linalg.norm(turned - (low + step * levels)))))
        self.size = float(np.sqrt((turned * turned).sum()))

    def along(self, stage: int, words: np.ndarray) -> np.ndarray:
        """The anchor's inner products with unit sign directions, but for what rounding lost."""
        low, step, total, planes, _ = self.stages[stage]
        ones = np.bitwise_count(words).sum(1).astype(np.int64)
        where = sum(np.bitwise_count(words & plane).sum(1).astype(np.int64) << bit for bit, plane in enumerate(planes))
        return (low * (2 * ones - self.dims) + step * (2 * where - total)) / np.sqrt(max(self.dims, 1))

    def lost(self, stage: int) -> float:
        return self.stages[stage][4]


def narrowed(probe: Probe, words: list[np.ndarray], aligns: np.ndarray, rests: np.ndarray, at: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lower ends, upper ends) of the vectors at ``at`` that no stage's intervals rule out."""
    sure, unsure = np.zeros(len(at)), np.zeros(len(at))
    low = high = sure
    for stage in range(STAGES):
        along = probe.along(stage, words[stage][at])
        sure, unsure = sure + aligns[at, stage] * along, unsure + aligns[at, stage] * probe.lost(stage)
        least = np.maximum(np.abs(along) - probe.lost(stage), 0.0)
        apart = np.sqrt(np.maximum(probe.size * probe.size - least * least, 0.0))
        half = unsure + rests[at, stage + 1] * apart + SLACK * rests[at, 0] * (probe.size + 1.0)
        low, high = probe.scale * (sure - half), probe.scale * (sure + half)
        keep = useful(low, high)
        at, sure, unsure, low, high = at[keep], sure[keep], unsure[keep], low[keep], high[keep]
    return at, low, high


def scores(ints: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows with an integer-valued vector, as 64-bit integers."""
    if not len(ints) or float(np.abs(ints).max(initial=0.0)) * float(np.abs(anchor).max(initial=0.0)) * max(len(anchor), 1) < EXACT:
        return ints.astype(np.int64) @ anchor.astype(np.int64)
    whole = [int(x) for x in anchor.tolist()]
    sums = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in ints.tolist()]
    if any(not -(1 << 63) <= s < 1 << 63 for s in sums):
        raise OverflowError("an inner product passes 64 bits")
    return np.array(sums, np.int64)


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Shard:
    """The vectors of one shard and length, in arrays."""

    def __init__(self, table: pa.Table):
        self.rows, self.ids, self.labels = (table[c].to_numpy() for c in ("_row", "_id", "_label"))
        n, dims = table.num_rows, table["_dims"][0].as_py()
        flat = lambda c: table[c].combine_chunks().flatten()
        self.ints = flat("_ints").to_numpy(zero_copy_only=False).reshape(n, dims)
        code = np.frombuffer(b"".join(flat("_codes").to_pylist()), np.uint64).reshape(n, STAGES, -1)
        self.words = [np.ascontiguousarray(code[:, stage]) for stage in range(STAGES)]
        self.aligns, self.rests = (flat(c).to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("_aligns", "_rests"))

    def positives(self, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best other rows of the anchor's label."""
        same = np.flatnonzero((self.labels == label) & (self.rows != row))
        left, _, _ = narrowed(Probe(anchor), self.words, self.aligns, self.rests, same, lambda low, high: high >= kth_largest(low, k))
        exact = scores(self.ints[left], anchor)
        best = np.lexsort((self.ids[left], ~exact))[:k]
        return left[best], exact[best]

    def negatives(self, label: int, anchor: np.ndarray, bands: list[tuple[int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the k best rows of other labels within each band of scores."""

        def within(low: np.ndarray, high: np.ndarray, floor: int, ceiling: int) -> np.ndarray:
            sure = low[(low >= floor) & (high <= ceiling)]
            return (high >= max(floor, kth_largest(sure, k))) & (low <= ceiling)

        def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(low), bool)
            for band in bands:
                keep |= within(low, high, *band)
            return keep

        left, low, high = narrowed(Probe(anchor), self.words, self.aligns, self.rests, np.flatnonzero(self.labels != label), useful)
        for floor, ceiling in bands:
            some = left[within(low, high, floor, ceiling)]
            exact = scores(self.ints[some], anchor)
            inside = (exact >= floor) & (exact <= ceiling)
            some, exact = some[inside], exact[inside]
            best = np.lexsort((self.ids[some], ~exact))[:k]
            yield some[best], exact[best]


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component as doubles, null for vectors that take no part."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # a double of 2^53 or more is whole; floor() would give a 64-bit integer
    whole = lambda x: F.when(F.abs(x * 256) < float(1 << 53), F.floor(x * 256).cast("double")).otherwise(x * 256)
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(values, whole))


def coded(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """The written table of codes: row number, id, label, integers, and each stage's sign bits, alignment and residual length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), label.cast("int").alias("_label"), quantised(F.col(vector_col)).alias("_ints"))
    rows = rows.where("_id is not null and _label is not null and _ints is not null").select(F.monotonically_increasing_id().alias("_row"), "_id", "_label", F.size("_ints").alias("_dims"), "_ints")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                ints = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                words, aligns, rests = codes(ints)
                packed = [[stage[i].tobytes() for stage in words] for i in range(len(ints))]
                yield pa.record_batch([*part.columns[:4], part.column(4).cast(pa.list_(pa.float64())), pa.array(packed, CODED_ARROW.field("_codes").type), pa.array(aligns.tolist()), pa.array(rests.tolist())], schema=CODED_ARROW)

    return stored(rows.mapInArrow(code, CODED), "codes")


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 5, low_pct: int = 80, high_pct: int = 100, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is an expression of the id column; ``label`` of any column.  A negative's score lies between
    ``low_pct`` and ``high_pct`` hundredths of the positive's.
    """
    rows = coded(vectors, label, id_col, vector_col)
    anchors = rows.withColumnRenamed("_id", id_col).where(is_anchor).withColumnRenamed(id_col, "_id").select(*[F.col(f"_{c}").alias(c) for c in ("row", "id", "label", "dims", "ints")])
    counted = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"], anchors.count()
    n_shards, n_blocks = (max(1, -(-n // size)) for n, size in zip(counted, (SHARD, ANCHOR_BLOCK), strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda row, n: F.pmod(F.xxhash64(row), F.lit(n)).cast("int")
    held = rows.select("*", dealt("_row", n_shards).alias("shard")).select("*", every(n_blocks).alias("block")).groupBy("shard", "block", "_dims")
    asking = lambda frame: frame.select("*", dealt("row", n_blocks).alias("block")).select("*", every(n_shards).alias("shard")).groupBy("shard", "block", "dims")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = Shard(left)
            for row, _, mark, ints in zip(*(right[c].to_pylist() for c in ("row", "id", "label", "ints")), strict=True):
                at, exact = shard.positives(row, mark, np.array(ints, np.float64), positives)
                out += [(row, int(shard.rows[i]), int(shard.ids[i]), int(s)) for i, s in zip(at, exact, strict=True)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["row", "near_row", "near", "score"])

    partial = held.cogroup(asking(anchors)).applyInArrow(near, "row long, near_row long, near long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "near", "near_row")
    best = partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = stored(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "near", "score"))).alias("pairs")), "positives")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = Shard(left)
            for row, own, mark, ints, held_pairs in zip(*(right[c].to_pylist() for c in ("row", "id", "label", "ints", "pairs")), strict=True):
                bands = [(-(-low_pct * p["score"] // 100), high_pct * p["score"] // 100) for p in held_pairs]
                for p, (at, exact) in zip(held_pairs, shard.negatives(mark, np.array(ints, np.float64), bands, negatives), strict=True):
                    out += [(row, own, p["place"], p["near"], p["score"], int(shard.rows[i]), int(shard.ids[i]), int(s)) for i, s in zip(at, exact, strict=True)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(8)], names=["row", "anchor_id", "place", "positive_id", "positive_score", "far_row", "negative_id", "negative_score"])

    partial = held.cogroup(asking(anchors.join(pairs, "row"))).applyInArrow(hard, "row long, anchor_id long, place long, positive_id long, positive_score long, far_row long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "far_row"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
