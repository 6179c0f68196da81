"""Feature contracts over walk-forward windows, all fitted together in passes over one table of packed rows.

The training rows are written once as blocks, each a matrix by columns with its rows in order of days, so a pass decodes
no cells and a window's rows are the first of a block.  A pass leaves one row of sums per task.  The first gives the mean of every
feature in every window's training rows, the second the products of what is left, so spreads and correlations; exact
medians are taken only of features that have gaps.  All contracts of all windows are then fitted together: each pass
gives every contract's slope of the penalised likelihood, and a step solves for it with the bound of the curvature that
the correlations give, which is taken once.  As long as chances lie near one half that bound is nearly the curvature
itself, so a few passes fit any number of contracts, and a step never overshoots.  The last pass proves each fit: its
slope, and its loss beside that of the base rate.  One more pass scores the windows' later rows with all contracts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.operators.features import exact_medians
from slatewise.operators.learners import LOGISTIC_C
from slatewise.operators.metrics import CLIP
from slatewise.session import stored

BLOCK_ROWS = 2048
STEPS, FLAT = 60, 1e-8  # passes at most, and the slope that ends them
FACTS = "window string, candidate string, train_n long, wins long, features int, gradient double, loss double, base_loss double"


@dataclass(frozen=True)
class Scale:
    """What a window's training rows say about every feature."""

    name: str
    start: str
    end: str
    rows: int
    wins: int
    fills: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    products: np.ndarray  # correlations; a constant feature has none

    def training(self) -> Column:
        return F.col("game_date") < F.lit(self.start).cast("date")

    def validation(self) -> Column:
        return F.col("game_date").between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))


@dataclass
class Fit:
    """A contract's coefficients over the whole scaled row, 0 outside the contract, and what the last pass said of them."""

    weights: np.ndarray
    intercept: float
    slope: float = math.inf
    loss: float = math.inf


def plain(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(game_pk, game_date, a_win, features): doubles, unknown numbers as null."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.select(F.col("game_pk").cast("long"), "game_date", F.col("a_win").cast("int"), *[value(c).alias(c) for c in columns])


def packed(rows: DataFrame, columns: Sequence[str], before: str) -> DataFrame:
    """(days, wins, matrix): all rows of :func:`plain` dated before ``before`` in blocks; unknown numbers are NaN.  Written, as every pass scans it."""
    names = list(columns)
    schema = pa.schema([("days", pa.binary()), ("wins", pa.binary()), ("matrix", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day, y = batch.column("game_date").to_numpy(zero_copy_only=False).astype("datetime64[D]"), batch.column("a_win").to_numpy(zero_copy_only=False).astype(float)
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            blocks = []
            for a in range(0, len(day), BLOCK_ROWS):
                order = a + np.argsort(day[a : a + BLOCK_ROWS], kind="stable")
                blocks.append((day[order].astype(np.int64).tobytes(), y[order].tobytes(), np.array([c[order] for c in x], float).tobytes()))
            yield pa.record_batch([pa.array([b[i] for b in blocks], pa.binary()) for i in range(3)], schema=schema)

    early = rows.where(F.col("game_date") < F.lit(before).cast("date")).select("game_date", "a_win", *names)
    return stored(early.mapInArrow(pack, "days binary, wins binary, matrix binary"), "blocks")


def _summed(blocks: DataFrame, starts: Sequence[str], of: Callable[[int, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``of(window, matrix, outcomes)`` over each window's training rows: one vector per window."""
    days = np.array([np.datetime64(s, "D").astype(np.int64) for s in starts])
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(days), width))
        for batch in batches:
            for day, y, matrix in zip(*batch.columns, strict=True):
                day, y = np.frombuffer(day.as_buffer(), np.int64), np.frombuffer(y.as_buffer())
                x = np.frombuffer(matrix.as_buffer()).reshape(-1, len(day)).T
                for w, n in enumerate(np.searchsorted(day, days)):
                    if n:
                        total[w] += of(w, x[:n], y[:n])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], schema=schema)

    found = blocks.mapInArrow(sums, "sums array<double>").agg(Summarizer.sum(array_to_vector("sums"))).first()[0]
    return found.toArray().reshape(len(days), width)


def window_scales(rows: DataFrame, columns: Sequence[str], windows: Sequence[tuple[str, str, str]], minimum_train: int, blocks: DataFrame | None = None) -> list[Scale]:
    """Scales of the windows that hold enough training rows and any validation row; ``blocks`` are the rows :func:`packed`."""
    nothing = np.zeros(0)
    bare = [Scale(*w, 0, 0, nothing, nothing, nothing, nothing) for w in windows]
    counted = rows.agg(
        *[F.count_if(w.training()).alias(f"n{i}") for i, w in enumerate(bare)], *[F.count_if(w.training() & (F.col("a_win") == 1)).alias(f"w{i}") for i, w in enumerate(bare)],
        *[F.count_if(w.validation()).alias(f"v{i}") for i, w in enumerate(bare)], *[F.count_if(F.col(c).isNull()).alias(f"holes{i}") for i, c in enumerate(columns)],
    ).first()
    gaps = [i for i, _ in enumerate(columns) if counted[f"holes{i}"]]
    used = [(i, w) for i, w in enumerate(bare) if counted[f"n{i}"] >= minimum_train and counted[f"v{i}"]]
    if not used:
        raise ValueError("no window holds enough rows")
    fills = np.zeros((len(used), len(columns)))
    for k, (_, w) in enumerate(used):
        if gaps:
            named = rows.where(w.training()).select(*[F.col(columns[g]).alias(str(g)) for g in gaps])
            for row in exact_medians(named, [str(g) for g in gaps]).collect():  # one median a feature
                fills[k, int(row["feature"])] = row["median"]
    starts, width = [w.start for _, w in used], len(columns)
    if blocks is None:
        blocks = packed(rows, columns, max(starts))
    n = np.array([counted[f"n{i}"] for i, _ in used], float)
    means = _summed(blocks, starts, lambda w, x, y: np.where(np.isnan(x), fills[w], x).sum(0), width) / n[:, None]

    def products(w: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        centred = np.where(np.isnan(x), fills[w], x) - means[w]
        return (centred.T @ centred).ravel()

    mean_products = _summed(blocks, starts, products, width * width).reshape(len(used), width, width) / n[:, None, None]
    out = []
    for k, (i, w) in enumerate(used):
        spreads = np.sqrt(np.diag(mean_products[k]))
        spreads = np.where(spreads > 1e-12 * np.maximum(1.0, np.abs(means[k])), spreads, 1.0)  # a constant leaves rounding only
        out.append(Scale(w.name, w.start, w.end, counted[f"n{i}"], counted[f"w{i}"], fills[k], means[k], spreads, mean_products[k] / np.outer(spreads, spreads)))
    return out


def _weights(fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([f.weights for f in fits]), np.array([f.intercept for f in fits])


def fit_together(blocks: DataFrame, columns: Sequence[str], scales: Sequence[Scale], contracts: dict[str, Sequence[int]]) -> list[dict[str, Fit]]:
    """L2 logistic fits of every contract (places in ``columns``) on every window's training rows, one pass a step."""
    width, count, low = len(columns), len(contracts), CLIP
    penalties = [1.0 / (LOGISTIC_C * s.rows) for s in scales]
    shape = [(s.fills, s.means, s.spreads) for s in scales]
    fits = []
    for s in scales:
        rate = min(max(s.wins / s.rows, CLIP), 1.0 - CLIP)
        fits.append({name: Fit(np.zeros(width), math.log(rate / (1.0 - rate))) for name in contracts})
    bounds = [{name: 0.25 * s.products[np.ix_(own, own)] + penalties[k] * np.eye(len(own)) for name, own in contracts.items()} for k, s in enumerate(scales)]
    for step in range(STEPS):
        given = [_weights(list(f.values())) for f in fits]

        def slopes(w: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            fill, mean, spread = shape[w]
            z = (np.where(np.isnan(x), fill, x) - mean) / spread
            p = 1.0 / (1.0 + np.exp(-(z @ given[w][0] + given[w][1])))
            r, q = p - y[:, None], np.clip(p, low, 1.0 - low)
            losses = -np.log(np.where(y[:, None] == 1, q, 1.0 - q))
            return np.concatenate([(z.T @ r).ravel(), r.sum(0), losses.sum(0)])

        sums = _summed(blocks, [s.start for s in scales], slopes, (width + 2) * count)
        for k, s in enumerate(scales):
            found = sums[k].reshape(width + 2, count) / s.rows
            for i, (name, own) in enumerate(contracts.items()):
                fit, down, off = fits[k][name], found[:width, i][own] + penalties[k] * fits[k][name].weights[own], float(found[width, i])
                fit.slope, fit.loss = float(max(np.abs(down).max(initial=0.0), abs(off))), float(found[width + 1, i])
                if step < STEPS - 1 and fit.slope > FLAT:
                    fit.weights[own] -= np.linalg.solve(bounds[k][name], down)
                    fit.intercept -= 4.0 * off
        if all(fit.slope <= FLAT for window in fits for fit in window.values()):
            break
    return fits


def _scored(rows: DataFrame, columns: Sequence[str], scale: Scale, fits: dict[str, Fit]) -> DataFrame:
    """The window's validation rows with every contract's probability, one row a contract."""
    names, candidates = list(columns), list(fits)
    fill, mean, spread = scale.fills, scale.means, scale.spreads
    weights, intercepts = _weights(list(fits.values()))
    schema = pa.schema([("game_pk", pa.int64()), ("game_date", pa.date32()), ("a_win", pa.int32()), ("probability", pa.list_(pa.float64()))])

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            p = 1.0 / (1.0 + np.exp(-((np.where(np.isnan(x), fill, x) - mean) / spread @ weights + intercepts)))
            ends = pa.array(np.arange(0, p.size + 1, len(candidates)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("game_pk"), batch.column("game_date"), batch.column("a_win"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], schema=schema)

    scored = rows.where(scale.validation()).mapInArrow(chances, "game_pk long, game_date date, a_win int, probability array<double>")
    named = F.arrays_zip(F.array(*[F.lit(n) for n in candidates]).alias("candidate"), F.col("probability"))
    return scored.select("game_pk", "game_date", "a_win", F.lit(scale.name).alias("window"), F.inline(named).alias("candidate", "probability"))


def walk_forward(rows: DataFrame, columns: Sequence[str], windows: Sequence[tuple[str, str, str]], contracts: dict[str, Sequence[str]], minimum_train: int) -> tuple[DataFrame, DataFrame]:
    """Out-of-window predictions of every contract, and the facts of every fit.

    Predictions: window, candidate, game_pk, game_date, a_win, probability.  Windows and contracts are settings; each
    window is fitted on its earlier dates.  ``rows`` should be a written table: it is scanned a few times.
    """
    place = {c: i for i, c in enumerate(columns)}
    chosen = {name: [place[c] for c in own] for name, own in contracts.items()}
    table = plain(rows, columns)
    blocks = packed(table, columns, max(start for _, start, _ in windows))
    scales = window_scales(table, columns, windows, minimum_train, blocks)
    predictions, facts = None, []
    for scale, fits in zip(scales, fit_together(blocks, columns, scales, chosen), strict=True):
        scored = _scored(table, columns, scale, fits)
        predictions = scored if predictions is None else predictions.unionByName(scored)
        rate = min(max(scale.wins / scale.rows, CLIP), 1.0 - CLIP)
        base = -(rate * math.log(rate) + (1.0 - rate) * math.log(1.0 - rate))
        facts += [(scale.name, name, scale.rows, scale.wins, len(contracts[name]), fit.slope, fit.loss, base) for name, fit in fits.items()]
    return predictions, rows.sparkSession.createDataFrame(facts, FACTS)
