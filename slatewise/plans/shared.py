"""Tables that many queries read, written once per application and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slatewise.operators import history, market
from slatewise.sources.adapters import Tables


def starter_rows(t: Tables) -> DataFrame:
    """Every contest with its starters' differences, narrow."""
    return t.written("starter_rows", lambda: history.with_starters(history.contest_rows(t.contests), history.starter_form(history.team_games(t.contests))))


def pair_rows(t: Tables) -> DataFrame:
    """Every pair of teams and date with the teams' differences."""
    build = lambda: history.pair_differences(t.contests, history.team_snapshot(history.team_games(t.contests)), history.snapshot_columns())
    return t.written("pair_rows", build)


def matchups(t: Tables) -> DataFrame:
    """Pregame features of every contest: :func:`history.matchup_features` from its two written parts."""
    return t.written("matchup_rows", lambda: history.join_pairs(starter_rows(t), pair_rows(t)))


def score_cells(t: Tables) -> DataFrame:
    """Every game's distinct scores with their draws: a quote joins one row instead of the draws."""
    return t.written("score_cells", lambda: market.score_cells(t.draws))
