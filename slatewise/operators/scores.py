"""Score distributions of games from their draws, folded where the draws lie.

The draws of a game mostly follow one another, so a task folds neighbours of one game into a row of flat arrays before
anything is sent.  Folded rows meet by game and fold once more; what travels is a game's distinct scores, never its draws.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

CELLS = ("away_runs", "home_runs", "n")
SCHEMA = "game_pk long, draws long, away_runs array<int>, home_runs array<int>, n array<long>"
UNKNOWN = np.iinfo(np.int64).min  # a missing score while it is folded
DENSE = 16  # places a row of a table of all scores may take

Flat = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def folded(game: np.ndarray, away: np.ndarray, home: np.ndarray, n: np.ndarray) -> Flat:
    """Cells whose neighbours of one game hold every score once, in order of the scores."""
    run = np.cumsum(np.append(False, game[1:] != game[:-1]))
    low, wide = (away.min(), home.min()), (np.ptp(away) + 1, np.ptp(home) + 1)
    if UNKNOWN not in low and (run[-1] + 1) * float(wide[0]) * float(wide[1]) <= DENSE * len(run):
        counts = np.bincount((run * wide[0] + away - low[0]) * wide[1] + home - low[1], weights=n)  # scores are few: no sort
        code = np.flatnonzero(counts)
        run_at, rest = np.divmod(code, wide[0] * wide[1])
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        return game[starts][run_at], rest // wide[1] + low[0], rest % wide[1] + low[1], counts[code].astype(np.int64)
    (a, a_at), (h, h_at) = np.unique(away, return_inverse=True), np.unique(home, return_inverse=True)
    code = (run * len(a) + a_at) * len(h) + h_at
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    first = order[starts]
    return game[first], away[first], home[first], np.add.reduceat(n[order], starts)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(UNKNOWN).to_numpy(zero_copy_only=False)


def _of_draws(batch: pa.RecordBatch) -> Flat:
    game, away, home = (_numbers(batch.column(c)) for c in ("game_pk", "away_runs", "home_runs"))
    return game, away, home, np.ones(len(game), np.int64)


def _of_rows(batch: pa.RecordBatch) -> Flat:
    away, home, n = (batch.column(c) for c in CELLS)
    sizes = away.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(_numbers(batch.column("game_pk")), sizes), _numbers(away.flatten()), _numbers(home.flatten()), _numbers(n.flatten())


def _rows(game: np.ndarray, away: np.ndarray, home: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, game[1:] != game[:-1]))
    ends = pa.array(np.append(starts, len(game)), pa.int32())
    lists = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind, mask=values == UNKNOWN))
    columns = [pa.array(game[starts], mask=game[starts] == UNKNOWN), pa.array(np.add.reduceat(n, starts)), lists(away, pa.int32()), lists(home, pa.int32()), lists(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["game_pk", "draws", *CELLS])


def _fold(flat):
    """The task function that folds neighbours of one game, also across batches; at most one game is held back."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Flat | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = flat(batch)
            cells = folded(*(cells if held is None else map(np.concatenate, zip(held, cells, strict=True))))
            game = cells[0]
            others = np.flatnonzero(game != game[-1])
            last = others[-1] + 1 if len(others) else 0  # where the cells of the last game begin
            if last:
                yield _rows(*(c[:last] for c in cells))
            held = tuple(c[last:] for c in cells)
        if held is not None:
            yield _rows(*held)

    return fold


def score_cells(draws: DataFrame) -> DataFrame:
    """One row per game: its draws, and its distinct scores with their draws as three arrays of one length."""
    parts = draws.select("game_pk", "away_runs", "home_runs").mapInArrow(_fold(_of_draws), SCHEMA)
    return parts.repartition(F.col("game_pk")).sortWithinPartitions("game_pk").mapInArrow(_fold(_of_rows), SCHEMA)
