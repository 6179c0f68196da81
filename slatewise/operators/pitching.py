"""Point-in-time starter and bullpen profiles from pitcher appearances.

The same date rule as in team form applies: a date's games see earlier dates only.  Running
sums work on one row per (key, date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.season_lines import FIP_CONSTANT, FIP_HOME_RUN, FIP_STRIKEOUT, FIP_WALK, first_stat, hitter_line, number
from slatewise.operators.history import _before, _rolling, clip

# Priors, fatigue weights and closer limits
STARTER_PRIOR_INNINGS, BULLPEN_PRIOR_INNINGS, PRIOR_FIP = 20.0, 60.0, 4.20
PRIOR_BATTERS, PRIOR_KBB = 85.0, 10.0
RECENT_STARTS = 3
FATIGUE_WEIGHTS = {1: 1.0, 2: 0.60, 3: 0.30}
FATIGUE_SCALE, FATIGUE_CAP = 110.0, 1.5
CLOSER_OUT = (25, 45)
CLOSER_TIRED = (15, 35)
USAGE_WEIGHTS = {0: 1.0, 1: 0.65, 2: 0.35}
USAGE_OLDER, USAGE_SCALE = 0.15, 125.0
LEVERAGE_STEPS = ((30, 0.0), (20, 0.35), (10, 0.75))
RELIEVER_MAX_STARTS, RELIEVER_START_SHARE = 2, 0.5
RECENT_GAMES = 4
FIP_SUMS = ("outs", "strikeouts", "walks", "hit_batters", "home_runs")


def with_roles(appearances: DataFrame) -> DataFrame:
    """Marks each side's starter (lowest id among its started rows); all others relieve."""
    starter = appearances.filter("is_starter = 1").groupBy("game_pk", "team").agg(F.min("pitcher_id").alias("starter_id"))
    joined = appearances.join(starter, ["game_pk", "team"], "left")
    role = F.when((F.col("is_starter") == 1) & (F.col("pitcher_id") == F.col("starter_id")), "S").otherwise("R")
    return joined.withColumn("role", role)


def shrunk_fip(prefix: str, prior_innings: float) -> Column:
    c = lambda name: F.col(f"{prefix}{name}")
    points = FIP_HOME_RUN * c("home_runs") + FIP_WALK * (c("walks") + c("hit_batters")) - FIP_STRIKEOUT * c("strikeouts")
    return (points + (PRIOR_FIP - FIP_CONSTANT) * prior_innings) / (c("outs") / 3.0 + prior_innings) + FIP_CONSTANT


def _sums_before(days: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    w = _before(key)
    return days.select(key, "game_date", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"_{c}") for c in names])


def pitcher_pit_profile(appearances: DataFrame) -> DataFrame:
    """Shrunk FIP, K-BB% and recent pitch counts of each starter before each start date."""
    starts = with_roles(appearances).filter("role = 'S'").withColumn("pitches", F.col("pitches").cast("double"))
    names = [*FIP_SUMS, "batters_faced", "starts"]
    days = starts.withColumn("starts", F.lit(1)).groupBy("pitcher_id", "game_date").agg(*[F.sum(c).alias(c) for c in names])
    before = _sums_before(days, "pitcher_id", names)
    kbb = 100.0 * (F.col("_strikeouts") - F.col("_walks") + PRIOR_BATTERS * PRIOR_KBB / 100.0) / (F.col("_batters_faced") + PRIOR_BATTERS)
    season = before.select(
        "pitcher_id", "game_date", shrunk_fip("_", STARTER_PRIOR_INNINGS).alias("starter_fip"), kbb.alias("starter_k_minus_bb"), F.col("_starts").alias("starter_starts_observed")
    )
    # a pitcher id can start for both sides of one game, so a start is a (game, team) pair
    starts = starts.withColumn("game_pk", F.struct("game_pk", "team"))
    recent = _rolling(starts, "pitcher_id", {"pitches": None}, (RECENT_STARTS,), "recent_", None)
    return season.join(recent.withColumnRenamed(f"recent_pitches{RECENT_STARTS}", "starter_recent_pitches"), ["pitcher_id", "game_date"])


def _relief_days(appearances: DataFrame) -> DataFrame:
    """One row per (team, date) of any appearance with the relievers' sums."""
    relief = F.when(F.col("role") == "R", 1).otherwise(0)
    return with_roles(appearances).groupBy("team", "game_date").agg(*[F.sum(F.col(c) * relief).alias(c) for c in (*FIP_SUMS, "pitches")])


def bullpen_pit_profile(appearances: DataFrame) -> DataFrame:
    """Shrunk relief FIP and weighted three-day fatigue of each team before each date."""
    days = _relief_days(appearances).withColumn("day", F.datediff("game_date", F.lit("1970-01-01")))
    by_day = Window.partitionBy("team").orderBy("day")
    load = sum((w * F.coalesce(F.sum("pitches").over(by_day.rangeBetween(-d, -d)), F.lit(0)) for d, w in FATIGUE_WEIGHTS.items()), F.lit(0.0))
    w = _before("team")
    sums = [F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"_{c}") for c in FIP_SUMS]
    rows = days.select("team", "game_date", load.alias("load"), *sums)
    return rows.select("team", "game_date", shrunk_fip("_", BULLPEN_PRIOR_INNINGS).alias("bullpen_xfip"), clip(F.col("load") / FATIGUE_SCALE, 0.0, FATIGUE_CAP).alias("bullpen_fatigue"))


def closer_availability(appearances: DataFrame) -> DataFrame:
    """Is the closer fresh: the reliever with most 3*saves + games finished so far.

    The score of a reliever never falls, so the leader before a date is the running maximum over
    all (score so far, pitcher) pairs; no roster is ever held as a list.
    """
    roles = with_roles(appearances)
    relief = roles.filter("role = 'R'").groupBy("team", "pitcher_id", "game_date").agg(
        F.sum("pitches").alias("pitches"), F.sum(3 * F.col("saves") + F.col("games_finished")).alias("points")
    )
    own = Window.partitionBy("team", "pitcher_id").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    scored = relief.withColumn("score", F.sum("points").over(own))
    leaders = scored.groupBy("team", "game_date").agg(F.max(F.struct("score", "pitcher_id")).alias("leader"))
    grid = appearances.select("team", "game_date").distinct().join(leaders, ["team", "game_date"], "left")
    closers = grid.select("team", "game_date", F.max("leader").over(_before("team"))["pitcher_id"].alias("pitcher_id"))
    looks = closers.select("team", "game_date", "pitcher_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("days_ago"))
    looks = looks.withColumn("seen", F.date_sub("game_date", F.col("days_ago")))
    thrown = relief.select("team", "pitcher_id", F.col("game_date").alias("seen"), "pitches")
    used = looks.join(thrown, ["team", "pitcher_id", "seen"], "left").groupBy("team", "game_date").agg(
        F.first("pitcher_id").alias("closer_id"),
        F.coalesce(F.sum(F.when(F.col("days_ago") == 1, F.col("pitches"))), F.lit(0)).alias("last1"),
        F.coalesce(F.sum("pitches"), F.lit(0)).alias("last2"),
    )
    over = lambda limit: (F.col("last1") >= limit[0]) | (F.col("last2") >= limit[1])
    return used.select("team", "game_date", "closer_id", F.when(over(CLOSER_OUT), 0.0).when(over(CLOSER_TIRED), 0.5).otherwise(1.0).alias("closer_available"))


CONTEXT_FIELDS = ("starter_fip", "starter_k_minus_bb", "bullpen_xfip", "bullpen_fatigue", "closer_available")


def pitching_context_rows(appearances: DataFrame, contests: DataFrame) -> DataFrame:
    """a-minus-b starter and bullpen differences per contest with appearances on both sides."""
    starters = with_roles(appearances).filter("role = 'S'").select("game_pk", "team", "game_date", "pitcher_id")
    profiles = starters.join(pitcher_pit_profile(appearances), ["pitcher_id", "game_date"])
    teams = bullpen_pit_profile(appearances).join(closer_availability(appearances), ["team", "game_date"])
    sides = profiles.join(teams, ["team", "game_date"]).select("game_pk", "team", F.struct(*CONTEXT_FIELDS).alias("s"))
    rows = contests.select("game_pk", "game_date", "team_a", "team_b")
    for side in ("a", "b"):
        rows = rows.join(sides.select("game_pk", F.col("team").alias(f"team_{side}"), F.col("s").alias(side)), ["game_pk", f"team_{side}"])
    return rows.select("game_pk", "game_date", "team_a", "team_b", *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c}_diff") for c in CONTEXT_FIELDS])


def dataset_audit(rows: DataFrame, required: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Row count, date range, missing columns, repeated ids and coverage of a built dataset."""
    missing = sorted(set(required) - set(rows.columns))
    per_id = rows.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n"), F.min("game_date").alias("first"), F.max("game_date").alias("last"), *[F.count(f).alias(f) for f in features]
    )
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("first").alias("date_min"), F.max("last").alias("date_max"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_game_pks"), *[(F.sum(f) / F.sum("n")).alias(f"{f}_coverage") for f in features],
    )
    good = F.lit(not missing) & (F.col("rows") > 0) & (F.col("duplicate_game_pks") == 0)
    return totals.withColumns({"missing_columns": F.lit(";".join(missing)), "status": F.when(good, "PASS").otherwise("FAIL")})


def recent_team_games(games: DataFrame, n: int = RECENT_GAMES) -> DataFrame:
    """The last n completed games of each team before each of its dates, with days ago.

    ``games``: team, game_date, game_pk, completed.  On one date lower ids come first.
    A date contributes at most n games, so a team's window runs over the calendar.
    """
    from slatewise.operators.positions import last_rows

    done = last_rows(games.filter("completed"), ["team", "game_date"], [F.col("game_pk").asc()], n)
    by_game = Window.partitionBy("team").orderBy(F.col("game_date").asc(), F.col("game_pk").desc()).rowsBetween(1 - n, 0)
    after = done.withColumn("last", F.collect_list(F.struct("game_date", "game_pk")).over(by_game)).filter("from_end = 1").select("team", "game_date", "last")
    days = games.select("team", "game_date").distinct().join(after, ["team", "game_date"], "left")
    before = days.select("team", F.col("game_date").alias("target_date"), F.last("last", ignorenulls=True).over(_before("team")).alias("last"))
    before = before.select("team", "target_date", F.explode("last").alias("g"))
    ago = F.greatest(F.lit(0), F.datediff("target_date", F.col("g.game_date")) - 1)
    return before.select("team", "target_date", F.col("g.game_pk").alias("game_pk"), ago.alias("days_ago"))


def bullpen_usage(recent: DataFrame, appearances: DataFrame) -> DataFrame:
    """Day-weighted relief load over recent games (team, target_date, game_pk, days_ago)."""
    relief = F.col("role") == "R"
    roles = with_roles(appearances).groupBy("game_pk", "team").agg(
        F.sum(F.when(relief, F.col("pitches"))).alias("pitches"), F.sum(F.when(relief, F.col("outs"))).alias("outs"), F.count_if(relief).alias("relievers"),
        F.sum(F.when(relief & (F.col("saves") > 0), F.col("pitches"))).alias("leverage"),
    )
    weight = F.lit(USAGE_OLDER)
    for days, w in USAGE_WEIGHTS.items():
        weight = F.when(F.col("days_ago") == days, w).otherwise(weight)
    rows = recent.join(roles, ["game_pk", "team"], "left").withColumn("w", weight)
    total = lambda c: F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0))
    out = rows.groupBy("team", "target_date").agg(
        F.count(F.lit(1)).alias("games_observed"), total("pitches").alias("relief_pitches"), (total("outs") / 3.0).alias("relief_innings"),
        total("relievers").alias("appearances"), (F.count("leverage") > 0).alias("known"), F.coalesce(F.sum(F.when(F.col("days_ago") == 0, F.col("leverage"))), F.lit(0)).alias("high"),
    )
    closer = F.lit(1.0)
    for limit, value in reversed(LEVERAGE_STEPS):
        closer = F.when(F.col("high") >= limit, value).otherwise(closer)
    return out.select(
        "team", "target_date", "games_observed", "relief_pitches", "relief_innings", "appearances",
        F.when(F.col("known"), F.col("high")).alias("high_leverage_pitches"), clip(F.col("relief_pitches") / USAGE_SCALE, 0.0, FATIGUE_CAP).alias("fatigue"),
        F.when(F.col("known"), closer).alias("closer_available"),
    )


LINEUP_RATES = ("obp", "slg", "ops", "iso", "walk_rate", "strikeout_rate", "woba_proxy")


def lineup_aggregate(lineups: DataFrame, seasons: DataFrame) -> DataFrame:
    """PA-weighted lineup rates per game and side; coverage is the share of hitters with PA."""
    parsed = seasons.select("player_id", *[c.alias(name) for name, c in hitter_line(F.col("payload")).items()])
    rows = lineups.join(parsed, "player_id", "left")
    pa = F.when(F.col("pa") > 0, F.col("pa"))
    mean = lambda c: F.sum(F.col(c) * pa) / F.sum(F.when(F.col(c).isNotNull(), pa))
    return rows.groupBy("game_pk", "side").agg(
        F.count(F.lit(1)).alias("players"), F.count(pa).alias("valid_players"), F.coalesce(F.sum(pa), F.lit(0.0)).alias("plate_appearances"),
        (F.count(pa) / F.count(F.lit(1))).alias("coverage"), *[mean(c).alias(c) for c in LINEUP_RATES],
    )


def reliever_filter(roster: DataFrame, seasons: DataFrame, starters: DataFrame) -> DataFrame:
    """Active relievers per game: pitched, seldom started, and not today's starter."""
    stat = first_stat(F.col("payload"))
    lines = seasons.select("pitcher_id", number(stat, "gamesPlayed").alias("games"), number(stat, "gamesStarted").alias("starts"))
    starts = F.coalesce("starts", F.lit(0.0))
    relief = (F.col("games") > 0) & ((starts <= RELIEVER_MAX_STARTS) | (starts / F.col("games") < RELIEVER_START_SHARE))
    return roster.join(lines.filter(relief), "pitcher_id").join(starters.select("game_pk", "pitcher_id"), ["game_pk", "pitcher_id"], "left_anti")
