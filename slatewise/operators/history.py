"""Point-in-time form from contest history.

Every value for a date uses only earlier dates, also when a team plays twice on one date.
The history is first reduced to one row per (key, date), plus at most the last *n* games of
that date where a rolling count of games needs them.  The ordered windows then run over the
calendar, whose length does not grow with the number of contests per team and day.

Functions take ``games`` (one row per team and contest, see :func:`team_games`) and
optionally ``wanted`` (team, game_date) rows such as a future slate; they return one row per
(team, game_date) with the state before that date.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.operators.positions import last_rows

# Priors, rolling lengths and decay rates of the form state
FORM_WINDOWS = (3, 5, 10, 20)
PRIOR_GAMES = 10.0
PRIOR_RUNS = 4.35
PRIOR_WIN = 0.5
PYTHAGOREAN_EXPONENT = 1.83
PRIOR_STARTS = 4.0
STARTER_WINDOW = 5
EWM_ALPHA = 0.25
EWM_BASELINE_ALPHA = 0.18
RESIDUAL_CLIP = 8.0
RESIDUAL_DIFF_CLIP = 12.0
BLOWOUT_MARGIN = 6
FORM_DEFAULTS = {"win": 0.5, "rf": 4.35, "ra": 4.35, "rd": 0.0}
LAST_GAME_DEFAULTS = {
    "last_game_known": 0.0,
    "last_win": 0.5,
    "last_rf": 4.35,
    "last_ra": 4.35,
    "last_rd": 0.0,
    "last_total_runs": 8.70,
    "last_abs_margin": 0.0,
    "last_was_home": 0.5,
    "last_opponent_win_pct": 0.5,
    "last_opponent_pyth": 0.5,
    "last_scored_shutout": 0.0,
    "last_was_shutout": 0.0,
    "last_blowout_win": 0.0,
    "last_blowout_loss": 0.0,
}
SUMMED_FEATURES = (
    "rf_pg", "ra_pg", "rf3", "ra3", "rf5", "ra5", "rf10", "ra10", "ewm_rf", "ewm_ra",
    "last_win", "last_rf", "last_ra", "last_rd", "last_total_runs",
    "last_abs_margin", "last_opponent_win_pct", "last_opponent_pyth",
    "last_scored_shutout", "last_was_shutout", "last_blowout_win", "last_blowout_loss",
)

STRENGTH = ("games", "win_pct", "pyth", "rf_pg", "ra_pg", "run_diff_pg")
ROLLING = tuple(f"{m}{n}" for m in FORM_DEFAULTS for n in FORM_WINDOWS)
MOMENTUM = tuple(f"form_{m}_momentum" for m in FORM_DEFAULTS)
EWM = ("ewm_rf", "ewm_ra", "ewm_win")
REST = ("rest_days", "games_last3", "games_last7")
ADJUSTED = tuple(f"opp_adj_{m}{n}" for m in FORM_DEFAULTS for n in FORM_WINDOWS) + tuple(
    f"opp_adj_form_{m}_momentum" for m in FORM_DEFAULTS
)
STARTER = ("starter_starts", "starter_team_win_pct", "starter_team_ra", "starter_recent_ra", "starter_recent_win")
KEY = ["team", "game_date"]
PAIR = ["team_a", "team_b", "game_date"]


def team_games(contests: DataFrame) -> DataFrame:
    """Both sides of every contest as rows, from one pass over the contests."""

    def side(me: str, other: str, won: Column, home: Column) -> Column:
        rf, ra = F.col(f"{me}_runs").cast("double"), F.col(f"{other}_runs").cast("double")
        return F.struct(
            F.col(f"team_{me}").alias("team"), F.col(f"team_{other}").alias("opponent"),
            won.cast("double").alias("win"), rf.alias("rf"), ra.alias("ra"), (rf - ra).alias("rd"),
            F.col(f"{me}_starter").alias("starter"), home.cast("double").alias("was_home"),
        )

    a_win, a_home = F.col("a_win"), F.col("team_a_is_home")
    sides = F.array(side("a", "b", a_win, a_home), side("b", "a", 1 - a_win, 1 - a_home))
    return contests.select("game_pk", "game_date", F.inline(sides))


def _days(games: DataFrame, key: str, wanted: DataFrame | None, **sums: str) -> DataFrame:
    """One row per (key, date) with its game count and sums; wanted dates count zero games."""
    played = games.select(key, "game_date", F.lit(1).alias("m"), *[F.col(c).alias(a) for a, c in sums.items()])
    if wanted is not None:
        extra = wanted.select(key, "game_date", F.lit(0).alias("m"), *[F.lit(0.0).alias(a) for a in sums])
        played = played.unionByName(extra)
    return played.groupBy(key, "game_date").agg(F.sum("m").alias("m"), *[F.sum(a).alias(a) for a in sums])


def _before(key: str):
    return Window.partitionBy(key).orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)


def _carry(after: DataFrame, key: str, defaults: dict[str, float], wanted: DataFrame | None) -> DataFrame:
    """State before each date from the state after each played date; ``defaults`` before the first."""
    states = after.select(key, "game_date", F.struct(*defaults).alias("after"))
    if wanted is not None:
        days = [key, "game_date"]
        extra = wanted.select(*days).distinct().join(states.select(*days), days, "left_anti")
        states = states.unionByName(extra, allowMissingColumns=True)
    before = states.select(key, "game_date", F.last("after", ignorenulls=True).over(_before(key)).alias("s"))
    return before.select(key, "game_date", *[F.coalesce(F.col(f"s.{c}"), F.lit(d)).alias(c) for c, d in defaults.items()])


def season_strength(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Shrunk win rate, run rates, run difference and Pythagorean share."""
    days = _days(games, "team", wanted, win="win", rf="rf", ra="ra")
    w = _before("team")
    total = {c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"_{c}") for c in ("m", "win", "rf", "ra")}
    weight = F.col("_m") + PRIOR_GAMES
    rates = days.select(*KEY, *total.values()).select(
        *KEY,
        F.col("_m").alias("games"),
        ((F.col("_win") + PRIOR_GAMES * PRIOR_WIN) / weight).alias("win_pct"),
        ((F.col("_rf") + PRIOR_GAMES * PRIOR_RUNS) / weight).alias("rf_pg"),
        ((F.col("_ra") + PRIOR_GAMES * PRIOR_RUNS) / weight).alias("ra_pg"),
    )
    scored, allowed = F.pow("rf_pg", F.lit(PYTHAGOREAN_EXPONENT)), F.pow("ra_pg", F.lit(PYTHAGOREAN_EXPONENT))
    return rates.withColumns({"run_diff_pg": F.col("rf_pg") - F.col("ra_pg"), "pyth": scored / (scored + allowed)})


def _rolling(rows: DataFrame, key: str, metrics: dict[str, float], lengths, prefix: str, wanted: DataFrame | None) -> DataFrame:
    """Means over the last n games before each date, from the last games of each date."""
    recent = last_rows(rows, [key, "game_date"], [F.col("game_pk").desc()], max(lengths))
    by_game = Window.partitionBy(key).orderBy("game_date", "game_pk")
    means = [
        F.avg(m).over(by_game.rowsBetween(-(n - 1), 0)).alias(f"{prefix}{m}{n}") for m in metrics for n in lengths
    ]
    after = recent.select(key, "game_date", "from_end", *means).filter("from_end = 1")
    return _carry(after, key, {f"{prefix}{m}{n}": d for m, d in metrics.items() for n in lengths}, wanted)


def _with_momentum(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}form_{m}_momentum": F.col(f"{prefix}{m}3") - F.col(f"{prefix}{m}10") for m in FORM_DEFAULTS})


def rolling_form(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Means of wins, runs for, against and difference over the last 3, 5, 10 and 20 games."""
    return _rolling(games, "team", FORM_DEFAULTS, FORM_WINDOWS, "", wanted)


def form_momentum(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Last-3 minus last-10 means."""
    return _with_momentum(rolling_form(games, wanted), "").select(*KEY, *MOMENTUM)


def ewm_form(games: DataFrame, wanted: DataFrame | None = None, alpha: float = EWM_ALPHA) -> DataFrame:
    """Exponentially weighted runs and wins, seeded with the priors.

    A date's games fold into one decayed sum and a count, so a state is a sum of
    ``value * keep**(games since)`` over dates.  Running sums of ``value * keep**-(games so far)``
    would overflow, so games are counted in blocks of ``depth``, the point where ``keep**depth``
    drops below 1e-18: a state needs its own block and the one before, older terms cannot change
    a double.  The same bound limits the games kept per date.
    """
    keep = 1.0 - alpha
    depth = 1
    while keep**depth >= 1e-18:
        depth += 1
    priors = {"rf": PRIOR_RUNS, "ra": PRIOR_RUNS, "win": PRIOR_WIN}
    weight = F.pow(F.lit(keep), F.col("from_end") - 1) * alpha
    recent = last_rows(games, KEY, [F.col("game_pk").desc()], depth)
    days = recent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(c) * weight).alias(c) for c in priors])
    by_date = Window.partitionBy("team").orderBy("game_date")
    days = days.withColumn("upto", F.sum("m").over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("block", F.floor((F.col("upto") - 1) / depth)).withColumn("age", F.col("upto") - F.col("block") * depth)
    days = days.withColumns({f"_{c}": F.col(c) * F.pow(F.lit(1.0 / keep), "age") for c in priors})
    inside = Window.partitionBy("team", "block").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    block_before = Window.partitionBy("team").orderBy("block").rangeBetween(-1, -1)

    def state(metric: str) -> Column:
        own = F.sum(f"_{metric}").over(inside) * F.pow(F.lit(keep), "age")
        older = F.coalesce(F.sum(f"_{metric}").over(block_before), F.lit(0.0)) * F.pow(F.lit(keep), F.col("age") + depth)
        return own + older + F.pow(F.lit(keep), "upto") * priors[metric]

    after = days.select(*KEY, *[state(m).alias(f"ewm_{m}") for m in priors])
    return _carry(after, "team", {f"ewm_{m}": p for m, p in priors.items()}, wanted)


def last_game_context(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The latest earlier game of each team, with its opponent's strength before that game."""
    fields = ["opponent", "win", "rf", "ra", "rd", "was_home"]
    latest = games.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "game_pk").alias("g")).select(*KEY, "g.*")
    strength = season_strength(games).select(F.col("team").alias("opponent"), "game_date", "win_pct", "pyth")
    flag = lambda condition: condition.cast("double")
    after = latest.join(strength, ["opponent", "game_date"]).select(
        *KEY,
        F.lit(1.0).alias("last_game_known"), F.col("win").alias("last_win"),
        F.col("rf").alias("last_rf"), F.col("ra").alias("last_ra"), F.col("rd").alias("last_rd"),
        (F.col("rf") + F.col("ra")).alias("last_total_runs"), F.abs("rd").alias("last_abs_margin"),
        F.col("was_home").alias("last_was_home"), F.col("win_pct").alias("last_opponent_win_pct"),
        F.col("pyth").alias("last_opponent_pyth"),
        flag(F.col("ra") == 0).alias("last_scored_shutout"), flag(F.col("rf") == 0).alias("last_was_shutout"),
        flag(F.col("rd") >= BLOWOUT_MARGIN).alias("last_blowout_win"),
        flag(F.col("rd") <= -BLOWOUT_MARGIN).alias("last_blowout_loss"),
    )
    return _carry(after, "team", LAST_GAME_DEFAULTS, wanted)


def rest_density(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Days of rest and recent load.  Load counts look at the last ten games only."""
    days = _days(games, "team", wanted).withColumn("day", F.datediff("game_date", F.lit("1970-01-01")))
    by_day = Window.partitionBy("team").orderBy("day")
    last_played = F.last(F.when(F.col("m") > 0, F.col("day")), ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    load = lambda n: F.least(F.lit(10), F.coalesce(F.sum("m").over(by_day.rangeBetween(-n, -1)), F.lit(0))).cast("double")
    rest = F.when(last_played.isNull(), 3).otherwise(F.least(F.lit(7), F.col("day") - last_played)).cast("double")
    return days.select(*KEY, rest.alias("rest_days"), load(3).alias("games_last3"), load(7).alias("games_last7"))


def starter_form(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Per starter and date: starts, shrunk team results and the last five starts."""
    days = _days(games, "starter", wanted, win="win", ra="ra")
    w = _before("starter")
    totals = days.select("starter", "game_date", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"_{c}") for c in ("m", "win", "ra")])
    weight = F.col("_m") + PRIOR_STARTS
    season = totals.select(
        "starter", "game_date", F.col("_m").alias("starter_starts"),
        ((F.col("_win") + PRIOR_STARTS * PRIOR_WIN) / weight).alias("starter_team_win_pct"),
        ((F.col("_ra") + PRIOR_STARTS * PRIOR_RUNS) / weight).alias("starter_team_ra"),
    )
    recent = _rolling(games, "starter", {"ra": PRIOR_RUNS, "win": PRIOR_WIN}, (STARTER_WINDOW,), "starter_recent_", wanted)
    recent = recent.withColumnsRenamed({f"starter_recent_{m}{STARTER_WINDOW}": f"starter_recent_{m}" for m in ("ra", "win")})
    return season.join(recent, ["starter", "game_date"])


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), column))


def opponent_adjusted_form(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rolling residuals of results against the opponent's strength before each game."""
    strength = season_strength(games).select(F.col("team").alias("opponent"), "game_date", "win_pct", "pyth", "rf_pg", "ra_pg")
    tail = last_rows(games, KEY, [F.col("game_pk").desc()], max(FORM_WINDOWS)).drop("from_end", "rd")
    faced = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("win_pct") + F.col("pyth")) * 0.5))
    residuals = tail.join(strength, ["opponent", "game_date"]).select(
        "game_pk", *KEY,
        (F.col("win") - (1.0 - faced)).alias("win"),
        clip(F.col("rf") - F.col("ra_pg"), -RESIDUAL_CLIP, RESIDUAL_CLIP).alias("rf"),
        clip(F.col("rf_pg") - F.col("ra"), -RESIDUAL_CLIP, RESIDUAL_CLIP).alias("ra"),
    )
    residuals = residuals.withColumn("rd", clip(F.col("rf") + F.col("ra"), -RESIDUAL_DIFF_CLIP, RESIDUAL_DIFF_CLIP))
    return _with_momentum(_rolling(residuals, "team", dict.fromkeys(FORM_DEFAULTS, 0.0), FORM_WINDOWS, "opp_adj_", wanted), "opp_adj_")


def team_snapshot(games: DataFrame, wanted: DataFrame | None = None, alpha: float = EWM_ALPHA, opponent_adjusted: bool = False) -> DataFrame:
    """Every team column for each (team, game_date)."""
    parts = [
        season_strength(games, wanted),
        _with_momentum(rolling_form(games, wanted), ""),
        ewm_form(games, wanted, alpha),
        rest_density(games, wanted),
        last_game_context(games, wanted),
    ]
    if opponent_adjusted:
        parts.append(opponent_adjusted_form(games, wanted))
    return reduce(lambda left, right: left.join(right, KEY), parts)


def snapshot_columns(opponent_adjusted: bool = False) -> tuple[str, ...]:
    base = STRENGTH + ROLLING + MOMENTUM + EWM + REST + tuple(LAST_GAME_DEFAULTS)
    return base + ADJUSTED if opponent_adjusted else base


def with_starters(rows: DataFrame, starters: DataFrame) -> DataFrame:
    """Rows with the differences of both starters' states."""
    out = rows
    for s in ("a", "b"):
        state = starters.select(F.col("starter").alias(f"{s}_starter"), "game_date", F.struct(*STARTER).alias(f"s{s}"))
        out = out.join(state, [f"{s}_starter", "game_date"])
    return out.select(*rows.columns, *[(F.col(f"sa.{c}") - F.col(f"sb.{c}")).alias(f"{c}_diff") for c in STARTER])


def pair_differences(rows: DataFrame, teams: DataFrame, columns: Sequence[str], summed: Sequence[str] = SUMMED_FEATURES) -> DataFrame:
    """Every (team_a, team_b, game_date) of ``rows`` with a minus b of the teams' states, and a plus b of some.

    There are as many as pairs of a calendar, however many contests there are, so the wide values are made and sent once.
    """
    pairs = rows.select(*PAIR).distinct()
    for s in ("a", "b"):
        pairs = pairs.join(teams.select(F.col("team").alias(f"team_{s}"), "game_date", F.struct(*columns).alias(s)), [f"team_{s}", "game_date"])
    diffs = [(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c}_diff") for c in columns]
    sums = [(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(f"{c}_sum") for c in columns if c in summed]
    return pairs.select(*PAIR, *diffs, *sums)


def join_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of :func:`with_starters` with the values of their pair before those of the starters."""
    starter = [f"{c}_diff" for c in STARTER]
    return rows.join(pairs, PAIR).select(*[c for c in rows.columns if c not in starter], *[c for c in pairs.columns if c not in PAIR], *starter)


def contest_rows(contests: DataFrame) -> DataFrame:
    return contests.select("game_pk", "game_date", "team_a", "team_b", "a_runs", "b_runs", "a_win", "a_starter", "b_starter", "team_a_is_home")


def matchup_features(contests: DataFrame, alpha: float = EWM_ALPHA, opponent_adjusted: bool = False) -> DataFrame:
    """Pregame a-minus-b features for every contest in the history."""
    games, rows = team_games(contests), contest_rows(contests)
    pairs = pair_differences(rows, team_snapshot(games, None, alpha, opponent_adjusted), snapshot_columns(opponent_adjusted))
    return join_pairs(with_starters(rows, starter_form(games)), pairs)


def future_features(contests: DataFrame, targets: DataFrame, alpha: float = EWM_ALPHA, opponent_adjusted: bool = False) -> DataFrame:
    """Features for contests yet to be played, as of the day before each target date.

    Targets (game_pk, game_date, away_team, home_team, away_starter, home_starter) must all lie
    after the last date of the history; two scalars are read to check it.
    """
    first = targets.agg(F.min("game_date")).first()[0]
    last = contests.agg(F.max("game_date")).first()[0]
    if last is None:
        raise ValueError("the history is empty")
    if first is not None and first <= last:
        raise ValueError("target dates must lie after the last completed date")
    away_first = F.col("away_team") < F.col("home_team")
    rows = targets.select(
        "game_pk", "game_date", F.least("away_team", "home_team").alias("team_a"), F.greatest("away_team", "home_team").alias("team_b"),
        F.when(away_first, F.col("away_starter")).otherwise(F.col("home_starter")).alias("a_starter"),
        F.when(away_first, F.col("home_starter")).otherwise(F.col("away_starter")).alias("b_starter"),
        F.when(away_first, 0).otherwise(1).alias("team_a_is_home"),
    )
    games = team_games(contests)
    both = lambda a, b, name: rows.select("game_date", F.explode(F.array(a, b)).alias(name)).distinct()
    teams = team_snapshot(games, both("team_a", "team_b", "team"), alpha, opponent_adjusted)
    starters = starter_form(games, both("a_starter", "b_starter", "starter"))
    return join_pairs(with_starters(rows, starters), pair_differences(rows, teams, snapshot_columns(opponent_adjusted)))
