"""Pregame context, series history, recommendation gates and the slate itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import environment, odds
from slatewise.functions.season_lines import starter_line
from slatewise.operators.positions import position

# When an input becomes a must before the start, in minutes
STARTER_MINUTES, LINEUP_MINUTES, WEATHER_MINUTES = 8 * 60, 90, 3 * 60
# Home-oriented edges as (name, context field, lower is better)
HOME_EDGES = (
    ("starter_fip_edge_home", "starter_fip", True),
    ("starter_kbb_edge_home", "starter_k_minus_bb", False),
    ("starter_whip_edge_home", "starter_whip", True),
    ("lineup_ops_edge_home", "lineup_ops", False),
    ("lineup_woba_edge_home", "lineup_woba_proxy", False),
    ("lineup_k_rate_edge_home", "lineup_k_rate", True),
    ("bullpen_era_edge_home", "bullpen_era_proxy", True),
    ("bullpen_fatigue_edge_home", "bullpen_fatigue", True),
    ("closer_availability_edge_home", "closer_available", False),
    ("defense_fielding_edge_home", "defense_fielding_pct", False),
    ("defense_errors_edge_home", "defense_errors_per_game", True),
    ("travel_fatigue_edge_home", "travel_fatigue", True),
    ("injury_war_edge_home", "injury_war", True),
)
CONTEXT_FEATURES = (*[e[0] for e in HOME_EDGES], "lineup_coverage_min", "lineups_confirmed", "starters_confirmed")
# Selection and series policy
MINIMUM_PICK_PROBABILITY, MINIMUM_OVERLAP, SCORE_CONFLICT_MARGIN = 0.53, 4, 0.20
SERIES_MAX_PROBABILITY, SERIES_MIN_GAMES, SERIES_MIN_LOSSES = 0.57, 2, 2
SERIES_RUN_DEFICIT, SERIES_BLOWOUT, SERIES_SIGNALS = 6, 5, 2
BULLPEN_DISADVANTAGE, HIGH_LEVERAGE_PITCHES, CLOSER_WARNING = 35.0, 20.0, 0.35
CONFIDENCE_WEIGHTS = (0.70, 0.30)
SCORE_WEIGHT = 0.20
ENVIRONMENT_CLIP = (0.80, 1.20)


def reasons(*entries: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for c, name in entries]))


def live_context_assess(contexts: DataFrame) -> DataFrame:
    """Starter, lineup, weather, roster and roof status, block and warning reasons per game."""
    start = F.col("start_ts")
    minutes = F.timestamp_diff("SECOND", F.col("assessed_at"), start) / 60.0
    unknown = start.isNull()
    weather = F.col("temperature_f").isNotNull() | (F.coalesce("weather_condition", F.lit("")) != "") | (F.coalesce("wind_description", F.lit("")) != "")
    roof, roster = F.trim(F.coalesce("roof_status", F.lit(""))) != "", F.col("roster_loaded")
    parts = {
        "starter": (F.col("probable_pitchers_confirmed"), STARTER_MINUTES, "STARTER_UNRESOLVED", "STARTER_NOT_YET_CONFIRMED"),
        "lineup": (F.col("lineups_confirmed"), LINEUP_MINUTES, "LINEUP_UNCONFIRMED_NEAR_FIRST_PITCH", "LINEUP_NOT_YET_POSTED"),
        "weather": (weather, WEATHER_MINUTES, "WEATHER_UNAVAILABLE_NEAR_FIRST_PITCH", "WEATHER_NOT_YET_AVAILABLE"),
    }
    status, block, warn = {}, [(unknown, "MISSING_GAME_TIME")], []
    for name, (ready, within, blocked, pending) in parts.items():
        near = minutes <= within
        status[f"{name}_status"] = F.when(unknown, "BLOCKED").when(ready, "PASS").when(near, "BLOCKED").otherwise("PENDING")
        block.append((~unknown & ~ready & near, blocked))
        warn.append((~unknown & ~ready & ~near, pending))
    warn += [
        (~roster, "ROSTER_TRANSACTION_FEED_NOT_LOADED"),
        (~roof & F.col("venue_id").isNull(), "ROOF_STATUS_UNKNOWN"),
        (~roof & F.col("venue_id").isNotNull(), "ROOF_STATUS_NOT_DECLARED"),
    ]
    out = contexts.select("game_pk", *[c.alias(n) for n, c in status.items()], F.when(roster, "PASS").otherwise("PENDING").alias("roster_status"),
                          F.when(roof, "PASS").otherwise("PENDING").alias("roof_status"), reasons(*block).alias("block_reasons"), reasons(*warn).alias("warning_reasons"))
    return out.withColumn("overall_status", F.when(F.size("block_reasons") > 0, "BLOCKED").otherwise("PASS"))


def weather_normalise(contexts: DataFrame) -> DataFrame:
    values = environment.weather(F.col("temperature_f"), F.col("wind_description"), F.col("roof_status"), F.col("weather_condition"))
    return contexts.select("game_pk", *[c.alias(n) for n, c in values.items()])


def travel_load(contexts: DataFrame) -> DataFrame:
    miles = environment.haversine(F.col("last_latitude"), F.col("last_longitude"), F.col("venue_latitude"), F.col("venue_longitude"))
    rows = contexts.select("game_pk", "rest_days", "games_last3", miles.alias("distance_miles"), F.abs(F.col("venue_offset") - F.col("last_offset")).alias("time_zones_crossed"))
    return rows.withColumn("fatigue", environment.travel(F.col("distance_miles"), F.col("time_zones_crossed"), F.col("rest_days"), F.col("games_last3")))


def starter_line_normalise(seasons: DataFrame) -> DataFrame:
    return seasons.select("pitcher_id", *[c.alias(n) for n, c in starter_line(F.col("payload")).items()])


def context_edges_home(contexts: DataFrame) -> DataFrame:
    """Fixed home-oriented vector; an edge with a missing side is zero."""
    edge = lambda field, lower: F.coalesce((F.col(f"away_{field}") - F.col(f"home_{field}")) if lower else (F.col(f"home_{field}") - F.col(f"away_{field}")), F.lit(0.0))
    coverage = F.coalesce(F.least("away_lineup_stats_coverage", "home_lineup_stats_coverage"), F.lit(0.0))
    return contexts.select(
        "game_pk", *[edge(field, lower).alias(name) for name, field, lower in HOME_EDGES], coverage.alias("lineup_coverage_min"),
        F.col("lineups_confirmed").cast("double").alias("lineups_confirmed"), F.col("probable_pitchers_confirmed").cast("double").alias("starters_confirmed"),
    )


def context_diffs_canonical(contexts: DataFrame, paired: Sequence[str], neutral: Sequence[str]) -> DataFrame:
    """team_a minus team_b of every paired field; game-level fields pass through."""
    away_first = F.col("away_team") < F.col("home_team")
    diff = lambda f: F.when(away_first, F.col(f"away_{f}") - F.col(f"home_{f}")).otherwise(F.col(f"home_{f}") - F.col(f"away_{f}"))
    return contexts.select("game_pk", *[diff(f).alias(f"{f}_diff") for f in paired], *neutral, F.col("lineups_confirmed").cast("double").alias("lineup_confirmed"))


def starter_workload(rows: DataFrame, cap: float = 7.0) -> DataFrame:
    """Expected innings and batters faced from season length, rest and the last pitch count."""
    per_start = F.when(F.col("season_innings").isNotNull() & (F.col("games_started") != 0), F.col("season_innings") / F.greatest(F.lit(1.0), F.col("games_started"))).otherwise(5.25)
    tired = F.when(F.col("rest_days") < 4, 0.45).otherwise(0.0) + F.when(F.col("recent_pitches") >= 105, 0.25).otherwise(0.0)
    bounded = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), c))
    started = F.col("games_started") > 0
    faced = F.when(F.col("batters_faced").isNotNull() & started, F.col("batters_faced") / F.col("games_started"))
    by_innings = F.when(F.col("season_innings").isNotNull() & started, F.col("season_innings") / F.col("games_started") * 4.30)
    return rows.withColumns(
        {
            "expected_innings": bounded(per_start - tired, 3.0, cap),
            "expected_batters": F.when(faced.isNotNull() | by_innings.isNotNull(), bounded(F.coalesce(faced, by_innings), 12.0, 30.0)).otherwise(21.0),
            "workload_source": F.when(faced.isNotNull(), "season_batters_faced_per_start").when(by_innings.isNotNull(), "season_innings_per_start_proxy").otherwise("league_workload_prior"),
        }
    )


def expected_runs_blend(offense: Column, starter_ra9: Column, bullpen_ra9: Column, starter_innings: Column, park: Column, lineup: Column) -> Column:
    """Half offence, half innings-weighted opposing pitching, scaled and bounded."""
    ip = F.least(F.lit(9.0), F.greatest(F.lit(0.0), starter_innings))
    pitching = (starter_ra9 * ip + bullpen_ra9 * (9.0 - ip)) / 9.0
    return F.least(F.lit(12.0), F.greatest(F.lit(0.35), (0.5 * offense + 0.5 * pitching) * park * lineup))


def environment_factor(weather: Column, park: Column) -> Column:
    """Product of the known positive run factors, bounded."""
    known = lambda c: F.when(c > 0, c).otherwise(1.0)
    return F.least(F.lit(ENVIRONMENT_CLIP[1]), F.greatest(F.lit(ENVIRONMENT_CLIP[0]), known(weather) * known(park)))


def probability_blend(model: Column, score: Column, weight: float = SCORE_WEIGHT, home_shift: float = 0.0, team_a_is_home: Column | None = None) -> Column:
    """Model and score probability blended, with an optional home shift on the logit."""
    p = (1.0 - weight) * model + weight * score
    if not home_shift:
        return p
    inside = F.least(F.lit(1 - 1e-8), F.greatest(F.lit(1e-8), p))
    z = F.log(inside / (1.0 - inside)) + F.when(team_a_is_home == 1, home_shift).otherwise(-home_shift)
    return 1.0 / (1.0 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))


def confidence(p: Column, overlap: Column, models: Column) -> Column:
    a, b = CONFIDENCE_WEIGHTS
    return a * 2.0 * F.abs(p - 0.5) + b * F.coalesce(overlap / F.nullif(models, F.lit(0)), F.lit(0.0))


ORDER = [F.desc, F.desc, F.desc, F.asc]


def rank_slate(rows: DataFrame, slate: str = "game_date") -> DataFrame:
    """confidence_rank within each slate by (confidence, probability, overlap), highest first.

    A slate is ranked in sampled ranges of the order, so a huge slate is not sorted by one task.
    """
    order = [F.desc("confidence_score"), F.desc("pick_probability"), F.desc("model_overlap"), F.asc("game_pk")]
    return position(rows, [slate], order, "confidence_rank")


def select_top(rows: DataFrame, top_n: int, slate: str = "game_date") -> DataFrame:
    """selection_rank among the eligible rows of each slate and the top-n flag."""
    order = [F.desc("confidence_score"), F.desc("pick_probability"), F.desc("model_overlap"), F.asc("game_pk")]
    eligible = position(rows.filter("eligible_for_top_pick"), [slate], order, "selection_rank")
    passed = rows.filter("not eligible_for_top_pick").withColumn("selection_rank", F.lit(None).cast("long"))
    both = eligible.withColumn("selection_rank", F.col("selection_rank").cast("long")).unionByName(passed)
    return both.withColumn("is_top_pick", F.coalesce(F.col("selection_rank") <= top_n, F.lit(False)))


def selection_policy(rows: DataFrame, top_n: int | None, score_veto: bool = True) -> DataFrame:
    """Conflict annotations and eligibility; without a top_n no ranks, for a later policy that gives them.

    Rows: away_team, home_team, pick, pick_probability, model_overlap, away_votes, model_count,
    simulated_away_runs, simulated_home_runs, confidence_score.  Tied votes go home, tied scores away.
    """
    home_votes = F.col("model_count") - F.col("away_votes")
    component = F.when(F.col("away_votes") > home_votes, F.col("away_team")).otherwise(F.col("home_team"))
    known = F.col("simulated_away_runs").isNotNull() & F.col("simulated_home_runs").isNotNull()
    ahead = F.when(F.col("simulated_away_runs") >= F.col("simulated_home_runs"), F.col("away_team")).otherwise(F.col("home_team"))
    out = rows.withColumns(
        {
            "component_consensus_pick": component,
            "component_consensus_overlap": F.greatest(F.col("away_votes"), home_votes),
            "projected_score_pick": F.when(known, ahead).otherwise(F.col("pick")),
            "projected_score_margin": F.when(known, F.abs(F.col("simulated_away_runs") - F.col("simulated_home_runs"))).otherwise(0.0),
        }
    )
    score_conflict = (F.col("projected_score_pick") != F.col("pick")) & (F.col("projected_score_margin") >= SCORE_CONFLICT_MARGIN)
    why = reasons(
        (F.col("component_consensus_pick") != F.col("pick"), "COMPONENT_CONSENSUS_CONFLICT"),
        (score_conflict & F.lit(score_veto), "PROJECTED_SCORE_CONFLICT"),
        (F.col("pick_probability") < MINIMUM_PICK_PROBABILITY, "LOW_PROBABILITY"),
        (F.col("model_overlap") < MINIMUM_OVERLAP, "LOW_OVERLAP"),
    )
    out = out.withColumns({"ensemble_score_conflict": score_conflict, "reasons": why})
    out = out.withColumns({"selection_reasons": F.array_join("reasons", ";"), "eligible_for_top_pick": F.size("reasons") == 0}).drop("reasons")
    out = out.withColumn("selection_status", F.when(F.col("eligible_for_top_pick"), "ELIGIBLE").otherwise("PASS"))
    return out if top_n is None else select_top(out, top_n)


def append_reasons(existing: Column, extra: Column) -> Column:
    """Reason text with new reasons added once, in order."""
    old = F.filter(F.split(F.coalesce(existing, F.lit("")), ";"), lambda r: r != "")
    return F.array_join(F.array_distinct(F.concat(old, extra)), ";")


def live_context_policy(evaluated: DataFrame, assessed: DataFrame, top_n: int) -> DataFrame:
    """Blocks rows whose critical inputs are unresolved; probabilities stay untouched."""
    rows = evaluated.drop("selection_rank", "is_top_pick").join(assessed.select("game_pk", "block_reasons", "overall_status"), "game_pk")
    blocked = F.size("block_reasons") > 0
    out = rows.withColumns(
        {
            "selection_reasons": append_reasons(F.col("selection_reasons"), F.col("block_reasons")),
            "selection_status": F.when(blocked, "BLOCKED — LIVE CONTEXT").otherwise(F.col("selection_status")),
            "eligible_for_top_pick": F.col("eligible_for_top_pick") & ~blocked,
        }
    ).withColumn("live_context_status", F.col("overall_status"))
    return select_top(out.drop("block_reasons", "overall_status"), top_n)


# ---- current series -------------------------------------------------------------------------


def series_state(games: DataFrame) -> DataFrame:
    """Per team and date: the trailing run of games against one opponent before that date.

    ``games``: team, opponent, game_date, game_pk, win, rf, ra.  Each date folds into its own
    trailing run; runs then join over dates while a date holds one opponent only and it is the
    previous date's last.  Windows run over the calendar, never over all games of a team.
    """
    key = ["team", "game_date"]
    per_opponent = games.groupBy(*key, "opponent").agg(F.max("game_pk").alias("last_pk"))
    day = per_opponent.groupBy(*key).agg(F.max_by("opponent", "last_pk").alias("last_opponent"), F.max("last_pk").alias("top_pk"), F.count(F.lit(1)).alias("opponents"))
    others = per_opponent.join(day, key).filter("opponent != last_opponent").groupBy(*key).agg(F.max("last_pk").alias("cut_pk"))
    tail = games.join(day, key).join(others, key, "left").filter("opponent = last_opponent and (cut_pk is null or game_pk > cut_pk)")
    last_win = F.max(F.when(F.col("win") == 1, F.col("game_pk")))
    folded = tail.groupBy(*key, "last_opponent", "opponents").agg(
        F.count(F.lit(1)).alias("n"), F.sum("win").alias("wins"), F.sum("rf").alias("rf"), F.sum("ra").alias("ra"), F.sum(game_mark(0)).alias("ids"), F.sum(game_mark(1)).alias("ids2"),
        F.max_by(F.struct("game_pk", "win", "rf", "ra"), "game_pk").alias("latest"), last_win.alias("win_pk"),
    )
    after_win = tail.join(folded.select(*key, "win_pk"), key).groupBy(*key).agg(F.count_if(F.col("win_pk").isNull() | (F.col("game_pk") > F.col("win_pk"))).alias("losses"))
    folded = folded.join(after_win, key)
    by_date = Window.partitionBy("team").orderBy("game_date")
    fresh = (F.col("opponents") > 1) | ~F.lag("last_opponent").over(by_date).eqNullSafe(F.col("last_opponent"))
    rows = folded.withColumn("fresh", fresh.cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.sum(F.col("win_pk").isNotNull().cast("int")).over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("team", "island").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    losing = Window.partitionBy("team", "island", "streak").orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    after = rows.select(
        *key, F.struct(F.col("last_opponent").alias("opponent"), *[F.sum(c).over(run).alias(c) for c in ("n", "wins", "rf", "ra", "ids", "ids2")],
                       F.col("latest"), F.sum("losses").over(losing).alias("losing")).alias("after"),
    )
    before = F.last("after", ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, -1))
    return after.select(*key, before.alias("state"))


def game_mark(salt: int) -> Column:
    """A game's share in the mark of a set of games: two such sums agree for equal sets only, but for chance."""
    return F.pmod(F.xxhash64("game_pk", F.lit(salt)), F.lit(1 << 40))


def series_islands(slate: DataFrame, games: DataFrame) -> DataFrame:
    """The current series of each slate game (game_pk, game_date, away_team, home_team).

    Both clubs must have met last; else the game opens a series.  Both views must hold the same
    games; where they do not the status is INCONSISTENT.
    """
    states = series_state(games)
    rows = slate
    for side in ("away", "home"):
        rows = rows.join(states.select(F.col("team").alias(f"{side}_team"), "game_date", F.col("state").alias(side)), [f"{side}_team", "game_date"], "left")
    active = (F.col("away.opponent") == F.col("home_team")) & (F.col("home.opponent") == F.col("away_team"))
    same = (F.col("away.n") == F.col("home.n")) & (F.col("away.ids") == F.col("home.ids")) & (F.col("away.ids2") == F.col("home.ids2"))
    status = F.when(F.coalesce(active, F.lit(False)), F.when(same, "COMPLETE").otherwise("INCONSISTENT")).otherwise("SERIES_OPENER")
    rows = rows.withColumn("status", status)
    on = F.col("status") == "COMPLETE"
    count = lambda c: F.when(on, F.col(c).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "game_pk", "game_date", "away_team", "home_team", "status", count("away.n").alias("games_played"), count("away.wins").alias("away_wins"), count("home.wins").alias("home_wins"),
        count("away.rf").alias("away_runs"), count("home.rf").alias("home_runs"), F.when(on, F.col("away.latest")).alias("latest"),
        count("away.losing").alias("away_losing"), count("home.losing").alias("home_losing"),
    )


def series_summary(islands: DataFrame) -> DataFrame:
    """Latest winner, loser and margin, losing streaks and a one-line text per slate game."""
    away_won = F.col("latest.win") == 1
    winner = F.when(F.col("latest").isNotNull(), F.when(away_won, F.col("away_team")).otherwise(F.col("home_team")))
    loser = F.when(F.col("latest").isNotNull(), F.when(away_won, F.col("home_team")).otherwise(F.col("away_team")))
    score = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))
    leader = (
        F.when(F.col("away_wins") == F.col("home_wins"), F.concat(F.lit("Series tied "), score("away_wins", "home_wins")))
        .when(F.col("away_wins") > F.col("home_wins"), F.concat("away_team", F.lit(" leads "), score("away_wins", "home_wins")))
        .otherwise(F.concat("home_team", F.lit(" leads "), score("home_wins", "away_wins")))
    )
    diff = F.col("away_runs") - F.col("home_runs")
    runs = (
        F.when(diff == 0, "run differential even")
        .when(diff > 0, F.concat("away_team", F.lit(" +"), diff.cast("string"), F.lit(" runs")))
        .otherwise(F.concat("home_team", F.lit(" +"), (-diff).cast("string"), F.lit(" runs")))
    )
    opener = "Series opener; no immediately preceding games between these clubs"
    return islands.withColumns(
        {
            "latest_winner": winner,
            "latest_loser": loser,
            "latest_margin": F.abs(F.col("latest.rf") - F.col("latest.ra")).cast("long"),
            "run_differential": diff,
            "summary": F.when(F.col("status") == "COMPLETE", F.concat_ws("; ", leader, runs)).otherwise(opener),
        }
    )


def series_policy(evaluated: DataFrame, series: DataFrame, contexts: DataFrame, top_n: int) -> DataFrame:
    """Passes a modest pick when two or more current-series warnings agree; never changes p."""
    fields = ["bullpen_recent_pitches", "bullpen_high_leverage_pitches", "closer_available"]
    pregame = contexts.select("game_pk", *[f"{s}_{f}" for s in ("away", "home") for f in fields])
    drop = [c for c in ("selection_rank", "is_top_pick") if c in evaluated.columns]
    rows = evaluated.drop(*drop).join(series.drop("game_date", "away_team", "home_team", "latest"), "game_pk").join(pregame, "game_pk")
    away = F.col("pick") == F.col("away_team")
    own = lambda a, b: F.when(away, F.col(a)).otherwise(F.col(b))
    side = lambda f: own(f"away_{f}", f"home_{f}")
    behind = own("home_wins", "away_wins")
    deficit = own("home_runs", "away_runs") - own("away_runs", "home_runs")
    carried = side("bullpen_recent_pitches") - own("home_bullpen_recent_pitches", "away_bullpen_recent_pitches")
    yes = lambda c: F.coalesce(c, F.lit(False))
    signals = reasons(
        (behind >= SERIES_MIN_LOSSES, "SERIES_TRAILING_MULTIPLE_GAMES"),
        (deficit >= SERIES_RUN_DEFICIT, "SERIES_NEGATIVE_RUN_DIFFERENTIAL"),
        (yes((F.col("latest_loser") == F.col("pick")) & (F.col("latest_margin") >= SERIES_BLOWOUT)), "SERIES_LATEST_BLOWOUT_LOSS"),
        (yes(carried >= BULLPEN_DISADVANTAGE), "BULLPEN_CARRYOVER_DISADVANTAGE"),
        (yes((side("bullpen_high_leverage_pitches") >= HIGH_LEVERAGE_PITCHES) & (side("closer_available") <= CLOSER_WARNING)), "HIGH_LEVERAGE_BULLPEN_USED_YESTERDAY"),
    )
    rows = rows.withColumn("signals", signals)
    conflict = (F.col("games_played") >= SERIES_MIN_GAMES) & (F.col("pick_probability") <= SERIES_MAX_PROBABILITY) & (F.size("signals") >= SERIES_SIGNALS)
    rows = rows.withColumn("series_context_conflict", conflict)
    passed = F.when(F.col("selection_status") == "ELIGIBLE", "PASS — SERIES CONTEXT").otherwise("PASS — MODEL + SERIES CONTEXT")
    hit = F.col("series_context_conflict")
    out = rows.withColumns(
        {
            "selection_reasons": F.when(hit, append_reasons(F.col("selection_reasons"), F.col("signals"))).otherwise(F.col("selection_reasons")),
            "selection_status": F.when(hit, passed).otherwise(F.col("selection_status")),
            "eligible_for_top_pick": F.col("eligible_for_top_pick") & ~hit,
            "series_context_reasons": F.array_join("signals", ";"),
        }
    )
    return select_top(out.drop("signals", *[f"{s}_{f}" for s in ("away", "home") for f in fields]), top_n)


# ---- slate ----------------------------------------------------------------------------------


def component_counts(components: DataFrame) -> DataFrame:
    """Away votes and model count per game from long component rows (away_probability)."""
    return components.groupBy("game_pk").agg(F.count_if(F.col("away_probability") >= 0.5).alias("away_votes"), F.count(F.lit(1)).alias("model_count"))


def slate_evaluation(rows: DataFrame, components: DataFrame, top_n: int, home_shift: float = 0.0) -> DataFrame:
    """Full slate rows: blend, orient, pick, prices and edges, policy and ranks.

    Rows: game_pk, game_date, away_team, home_team, team_a, team_a_is_home, model_probability and
    score_probability of team a, away_odds, home_odds, simulated_away_runs, simulated_home_runs.
    """
    blended = probability_blend(F.col("model_probability"), F.col("score_probability"), SCORE_WEIGHT, home_shift, F.col("team_a_is_home"))
    a_away = F.col("team_a") == F.col("away_team")
    away_p = F.when(a_away, blended).otherwise(1.0 - blended)
    out = rows.join(component_counts(components), "game_pk").withColumn("away_probability", away_p)
    out = out.withColumn("home_probability", 1.0 - F.col("away_probability"))
    away = F.col("away_probability") >= F.col("home_probability")
    side = lambda name: F.when(away, F.col(f"away_{name}")).otherwise(F.col(f"home_{name}"))
    market = F.when(away, odds.no_vig(F.col("away_odds"), F.col("home_odds"))).otherwise(odds.no_vig(F.col("home_odds"), F.col("away_odds")))
    out = out.withColumns(
        {
            "pick": side("team"),
            "pick_probability": side("probability"),
            "pick_odds": side("odds"),
            "model_overlap": F.when(away, F.col("away_votes")).otherwise(F.col("model_count") - F.col("away_votes")),
            "no_vig_pick_probability": market,
        }
    )
    p, price = F.col("pick_probability"), odds.implied_probability(F.col("pick_odds"))
    out = out.withColumns(
        {
            "break_even_probability": price,
            "edge_vs_no_vig": p - F.col("no_vig_pick_probability"),
            "edge_vs_break_even": p - price,
            "fair_odds": odds.probability_to_american(p),
            "confidence_score": confidence(p, F.col("model_overlap"), F.col("model_count")),
        }
    )
    return rank_slate(selection_policy(out, top_n))


def track_analysis_join(production: DataFrame, shadow: DataFrame, components: DataFrame, draws: DataFrame) -> DataFrame:
    """Production games with their shadow, projected runs, votes and overlap."""
    runs = draws.groupBy("game_pk").agg(F.avg("away_runs").alias("projected_away_runs"), F.avg("home_runs").alias("projected_home_runs"))
    votes = component_counts(components)
    joined = production.join(shadow.select("game_pk", F.col("away_probability").alias("shadow_away_probability")), "game_pk", "left")
    out = joined.join(runs, "game_pk").join(votes, "game_pk")
    return out.withColumns(
        {
            "shadow_delta": F.col("shadow_away_probability") - F.col("away_probability"),
            "model_overlap": F.greatest(F.col("away_votes"), F.col("model_count") - F.col("away_votes")),
        }
    )


def pa_input_coverage(contexts: DataFrame, lineups: DataFrame, starters: DataFrame, bullpens: DataFrame, lineup_size: int = 9, minimum: float = 8.0 / 9.0) -> DataFrame:
    """Can a game be modelled plate appearance by plate appearance, and with what gaps.

    Lineups: game_pk, side, players, with_stats.  Starters: game_pk, side, workload_source.
    Bullpens: game_pk, side, relievers.
    """
    wide = contexts.select("game_pk", "probable_pitchers_confirmed", "lineups_confirmed")
    for side in ("away", "home"):
        of = lambda df, *cols, side=side: df.filter(F.col("side") == side).select("game_pk", *[F.col(c).alias(f"{side}_{c}") for c in cols])
        wide = wide.join(of(lineups, "players", "with_stats"), "game_pk", "left").join(of(starters, "workload_source"), "game_pk", "left").join(of(bullpens, "relievers"), "game_pk", "left")
    coverage = lambda s: F.least(F.coalesce(F.col(f"{s}_with_stats"), F.lit(0)), F.lit(lineup_size)) / lineup_size
    short = lambda s: F.coalesce(F.col(f"{s}_players"), F.lit(0)) < lineup_size
    no_pen = lambda s: F.coalesce(F.col(f"{s}_relievers"), F.lit(0)) == 0
    blocked = (
        F.when(~F.col("probable_pitchers_confirmed"), "starters_unconfirmed")
        .when(~F.col("lineups_confirmed") | short("away") | short("home"), "lineups_unconfirmed")
        .when((coverage("away") < minimum) | (coverage("home") < minimum), "lineup_coverage_below_minimum")
        .when(F.col("away_workload_source").isNull() | F.col("home_workload_source").isNull(), "starter_payload_missing")
    )
    prior = F.contains(F.concat_ws(";", "away_workload_source", "home_workload_source"), F.lit("prior"))
    parity = reasons(
        (coverage("away") < 1.0, "AWAY_LINEUP_PARTIAL_PRIOR_FILL"), (coverage("home") < 1.0, "HOME_LINEUP_PARTIAL_PRIOR_FILL"),
        (no_pen("away"), "AWAY_BULLPEN_ALL_STAFF_PROXY"), (no_pen("home"), "HOME_BULLPEN_ALL_STAFF_PROXY"),
        (F.lit(True), "BULLPEN_AVAILABILITY_DIAGNOSTIC_ONLY"), (prior, "STARTER_WORKLOAD_PRIOR_FALLBACK"),
    )
    return wide.select(
        "game_pk", F.when(blocked.isNull(), "READY").otherwise("BLOCKED").alias("status"), blocked.alias("block_reason"),
        F.when(blocked.isNull(), F.array_join(parity, ";")).alias("parity_reasons"), coverage("away").alias("away_coverage"), coverage("home").alias("home_coverage"),
    )
