"""The paired bootstrap as sums of vectors: one number a resample, however many rows there are.

A row enters each resample as often as its Poisson(1) weight says, a hash of its key and the resample, so weights are
made where the row lies and never travel.  Rows are dealt once by range of the probability, in both tracks.  A task
walks its range in order and adds up, for all resamples at once, weights, hits, squared errors and log losses, and for
the AUC how often a win lies above a loss inside the range, with the range's wins and losses.  One row of vectors leaves
each task; running sums over the ranges complete the AUC.  What is shuffled is the rows once and tasks x resamples numbers.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.operators.metrics import clipped, finite, log_loss

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# The mixing constants of the weights' hash, also written in the SQL checks
GOLDEN, MIX_1, MIX_2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
ROWS_AT_ONCE = 256
SUMS = ("n", "hits", "squares", "losses", "wins_above", "wins", "defeats")
MEASURES = ("accuracy", "brier", "log_loss", "auc")


def poisson_thresholds() -> list[int]:
    """The distribution function of Poisson(1) in 32 bits, up to its last step that they can hold."""
    out, total = [], 0.0
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        out.append(min(int(total * 2**32), 2**32 - 1))
    return sorted(set(out))


def _mixed(z: np.ndarray) -> np.ndarray:
    """Finalise 32-bit values so that every input bit reaches every output bit."""
    z = (z ^ (z >> np.uint32(16))) * np.uint32(MIX_1)
    z = (z ^ (z >> np.uint32(13))) * np.uint32(MIX_2)
    return z ^ (z >> np.uint32(16))


def weights(seeds: np.ndarray, resamples: int) -> np.ndarray:
    """Rows x (1 + resamples): weight 1 for the rows as they are, then that of every resample.

    Both halves of a 64-bit seed enter, one after the other, so rows share weights only where they share a seed.
    """
    seeds = seeds.astype(np.uint64)
    high, low = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32)
    steps = np.arange(1, resamples + 1, dtype=np.uint32) * np.uint32(GOLDEN)
    drawn = _mixed(_mixed(low[:, None] + steps[None, :]) ^ high[:, None])
    times = np.zeros(drawn.shape, np.int8)
    for threshold in poisson_thresholds():
        times += drawn >= np.uint32(threshold)
    return np.hstack([np.ones((len(seeds), 1)), times])


def seed(key: str) -> Column:
    """64 bits of a key's digest, the same in any SQL engine."""
    digits = F.md5(F.col(key).cast("string"))
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


class _Track:
    """Sums of one track over a range, for all resamples at once."""

    def __init__(self, resamples: int):
        self.sums = {name: np.zeros(resamples + 1) for name in SUMS}
        self.first = self.tied = None
        self.tie = [np.zeros(resamples + 1), np.zeros(resamples + 1)]  # wins and defeats at the probability in hand

    def add(self, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Rows in order of p."""
        self.first = float(p[0]) if self.first is None else self.first
        for name, values in (("n", np.ones(len(p))), ("hits", ((p >= 0.5) == (y == 1)).astype(float)), ("squares", (p - y) ** 2), ("losses", -np.log(np.where(y == 1, p, 1.0 - p)))):
            self.sums[name] += values @ w
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        won, lost = np.add.reduceat(w * (y == 1)[:, None], starts), np.add.reduceat(w * (y != 1)[:, None], starts)
        if self.tied is not None and self.tied != p[0]:
            self.close()
        won[0] += self.tie[0]
        lost[0] += self.tie[1]
        self.tied, self.tie = p[-1], [won[-1], lost[-1]]
        done = slice(0, len(starts) - 1)
        below = self.sums["defeats"] + np.cumsum(lost[done], axis=0) - lost[done]
        self.sums["wins_above"] += (won[done] * (below + lost[done] / 2.0)).sum(0)
        self.sums["wins"] += won[done].sum(0)
        self.sums["defeats"] += lost[done].sum(0)

    def close(self) -> None:
        won, lost = self.tie
        self.sums["wins_above"] += won * (self.sums["defeats"] + lost / 2.0)
        self.sums["wins"] += won
        self.sums["defeats"] += lost
        self.tie = [np.zeros_like(won), np.zeros_like(lost)]


def paired_bootstrap(df: DataFrame, outcome: str, baseline: str, candidate: str, key: str, iterations: int) -> DataFrame:
    """Candidate-minus-baseline differences: their value and 2.5/97.5 percentiles over resamples with replacement."""
    ok = finite(F.col(outcome)) & finite(F.col(baseline)) & finite(F.col(candidate))
    tracks = F.array(*[F.struct(F.lit(name).alias("track"), clipped(F.col(c)).alias("p")) for name, c in (("base", baseline), ("cand", candidate))])
    rows = df.filter(ok).select(seed(key).alias("seed"), F.col(outcome).cast("int").alias("y"), F.inline(tracks))
    if rows.isEmpty():
        raise ValueError("the bootstrap needs at least one matched prediction")
    schema = pa.schema([("track", pa.string()), ("first", pa.float64()), *[(name, pa.list_(pa.float64())) for name in SUMS]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, _Track] = {}
        for batch in batches:
            names = batch.column("track").to_numpy(zero_copy_only=False)
            seeds, y, p = (batch.column(c).to_numpy() for c in ("seed", "y", "p"))
            for name in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == name)
                for a in range(0, len(at), ROWS_AT_ONCE):
                    some = at[a : a + ROWS_AT_ONCE]
                    found.setdefault(name, _Track(iterations)).add(p[some], y[some], weights(seeds[some].view(np.uint64), iterations))
        for name, track in found.items():
            track.close()
            yield pa.RecordBatch.from_pylist([{"track": name, "first": track.first, **{k: v.tolist() for k, v in track.sums.items()}}], schema=schema)

    dealt = rows.repartitionByRange("track", "p").sortWithinPartitions("track", "p")
    ranges = dealt.mapInArrow(summed, "track string, first double, " + ", ".join(f"{name} array<double>" for name in SUMS))
    each = ranges.select("track", "first", F.posexplode(F.arrays_zip(*SUMS))).select("track", "first", "pos", "col.*")
    before = Window.partitionBy("track", "pos").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    each = each.withColumn("below", F.coalesce(F.sum("defeats").over(before), F.lit(0.0)))
    n = F.nullif(F.sum("n"), F.lit(0.0))
    pairs = F.nullif(F.sum("wins") * F.sum("defeats"), F.lit(0.0))
    measured = each.groupBy("track", "pos").agg(
        (F.sum("hits") / n).alias("accuracy"), (F.sum("squares") / n).alias("brier"), (F.sum("losses") / n).alias("log_loss"),
        (F.sum(F.col("wins_above") + F.col("wins") * F.col("below")) / pairs).alias("auc"),
    )
    sign = F.when(F.col("track") == "cand", 1.0).otherwise(-1.0)
    deltas = measured.groupBy("pos").agg(*[F.sum(F.col(m) * sign).alias(m) for m in MEASURES], *[F.count(m).alias(f"_{m}") for m in MEASURES])
    long = deltas.select("pos", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(f"_{m}") == 2, F.col(m)).alias("value")) for m in MEASURES])))
    drawn = F.when((F.col("pos") > 0) & finite(F.col("value")), F.col("value"))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("pos") == 0, F.col("value"))).alias("point"),
        F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.count(drawn).alias("bootstrap_samples"),
    )
