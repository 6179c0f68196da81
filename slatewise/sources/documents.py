"""Nested JSON documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions.season_lines import innings, number
from slatewise.operators.market import TOTAL_SIDES, quote_key

TEAM = "team: struct<id: bigint, name: string, abbreviation: string>"
PITCHER = "probablePitcher: struct<id: bigint, fullName: string>"
SCHEDULE_SCHEMA = f"""dates array<struct<date: string, games: array<struct<gamePk: bigint, officialDate: string, gameDate: string, doubleHeader: string,
    status: struct<abstractGameState: string, detailedState: string, codedGameState: string>, venue: struct<id: bigint, name: string>,
    teams: struct<away: struct<{TEAM}, score: bigint, {PITCHER}>, home: struct<{TEAM}, score: bigint, {PITCHER}>>>>>>"""
PLAYER = "struct<person: struct<id: bigint>, stats: struct<pitching: map<string,string>>>"
SIDE = f"struct<pitchers: array<bigint>, players: map<string,{PLAYER}>>"
BOXSCORE_SCHEMA = f"""struct<gameData: struct<game: struct<pk: bigint>, datetime: struct<officialDate: string>, teams: struct<away: struct<abbreviation: string>, home: struct<abbreviation: string>>>,
    liveData: struct<boxscore: struct<teams: struct<away: {SIDE}, home: {SIDE}>>>>"""
EVENTS_SCHEMA = """struct<id: string, commence_time: string, away_team: string, home_team: string, bookmakers: array<struct<key: string, title: string, last_update: string,
    markets: array<struct<key: string, last_update: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>>"""
# Provider market names
MARKETS = {"h2h": "moneyline", "spreads": "run_line", "totals": "game_total"}


def flatten_schedule(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """One record per scheduled game; a game's own official date beats its bucket's date."""
    days = docs.select(F.explode(F.from_json(payload, SCHEDULE_SCHEMA)["dates"]).alias("d"))
    games = days.select(F.col("d.date").alias("bucket"), F.explode("d.games").alias("g"))
    return games.select(
        F.col("g.gamePk").alias("game_pk"), F.coalesce(F.nullif(F.col("g.officialDate"), F.lit("")), "bucket").alias("official_date"), F.col("g.gameDate").alias("game_datetime"),
        F.col("g.doubleHeader").alias("double_header"), F.col("g.status.abstractGameState").alias("status_abstract"), F.col("g.status.detailedState").alias("status_detailed"),
        F.col("g.venue.name").alias("venue_name"), *[F.col(f"g.teams.{s}.{path}").alias(f"{s}_{name}") for s in ("away", "home")
          for path, name in (("team.abbreviation", "team"), ("score", "score"), ("probablePitcher.fullName", "pitcher"))],
    )


def flatten_boxscore(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per pitcher appearance in order; the first of a side starts.

    Where a side lacks its pitcher order, players with a pitching line take its place, started
    ones first, then by outs and id.
    """
    doc = feeds.select(F.from_json(payload, BOXSCORE_SCHEMA).alias("f"))
    sides = F.array(*[
        F.struct(F.col(f"f.gameData.teams.{s}.abbreviation").alias("team"), F.col(f"f.liveData.boxscore.teams.{s}").alias("box")) for s in ("away", "home")
    ])
    rows = doc.select(F.col("f.gameData.game.pk").alias("game_pk"), F.col("f.gameData.datetime.officialDate").alias("game_date"), F.inline(sides))
    stat = lambda player, key: F.coalesce(number(player["stats"]["pitching"], key), F.lit(0.0))
    outs = lambda player: F.rint(F.coalesce(innings(F.try_element_at(player["stats"]["pitching"], F.lit("inningsPitched"))), F.lit(0.0)) * 3.0)
    seen = lambda p: (outs(p) > 0) | (stat(p, "numberOfPitches") > 0) | (stat(p, "battersFaced") > 0) | (stat(p, "gamesStarted") > 0)
    lines = F.filter(F.map_values("box.players"), seen)
    ordered = F.array_sort(F.transform(lines, lambda p: F.struct((stat(p, "gamesStarted") <= 0).alias("late"), (-outs(p)).alias("o"), p["person"]["id"].alias("id"))))
    order = F.when(F.size("box.pitchers") > 0, F.col("box.pitchers")).otherwise(F.transform(ordered, lambda s: s["id"]))
    placed = rows.select("game_pk", "game_date", "team", F.col("box.players").alias("players"), F.posexplode(order).alias("place", "pitcher_id"))
    p = F.try_element_at("players", F.concat(F.lit("ID"), F.col("pitcher_id").cast("string")))
    return placed.select(
        "game_pk", "game_date", "team", "pitcher_id", "place", (F.col("place") == 0).alias("is_starter"), outs(p).cast("long").alias("outs"),
        *[stat(p, key).alias(name) for key, name in (("numberOfPitches", "pitches"), ("strikeOuts", "strikeouts"), ("baseOnBalls", "walks"), ("homeRuns", "home_runs"), ("battersFaced", "batters_faced"))],
    )


def american_price(price: Column) -> Column:
    whole = F.rint(price).cast("int")
    return F.when(F.abs(whole) >= 100, whole)


def provider_quotes_flatten(events: DataFrame, matches: DataFrame, payload: str = "payload") -> DataFrame:
    """Provider events to quotes of matched games, the latest update per quote key.

    ``matches``: event_id, game_pk, away_team, home_team.
    """
    e = events.select(F.from_json(payload, EVENTS_SCHEMA).alias("e")).select(F.col("e.id").alias("event_id"), F.explode("e.bookmakers").alias("b"))
    m = e.select("event_id", F.coalesce(F.nullif(F.trim("b.title"), F.lit("")), "b.key").alias("sportsbook"), F.col("b.last_update").alias("book_update"), F.explode("b.markets").alias("m"))
    o = m.select("event_id", "sportsbook", F.coalesce("m.last_update", "book_update").alias("updated"), F.col("m.key").alias("key"), F.inline("m.outcomes"))
    kind = F.lit(None).cast("string")
    for key, value in MARKETS.items():
        kind = F.when(F.col("key") == key, value).otherwise(kind)
    rows = o.withColumns({"market_type": kind, "selection": F.upper(F.trim("name")), "american_odds": american_price(F.col("price")), "line": F.col("point"), "team": F.lit(None).cast("string")})
    rows = rows.join(matches, "event_id").filter("market_type is not null and american_odds is not null and sportsbook is not null")
    club = F.col("selection").isin(F.col("away_team"), F.col("home_team"))
    total = F.col("selection").isin(*TOTAL_SIDES) & F.col("line").isNotNull()
    valid = F.when(F.col("market_type") == "game_total", total).when(F.col("market_type") == "run_line", club & F.col("line").isNotNull()).otherwise(club)
    rows = rows.filter(valid).withColumn("line", F.when(F.col("market_type") != "moneyline", F.col("line")))
    fields = ("game_pk", "sportsbook", "market_type", "selection", "line", "american_odds", "updated")
    best = rows.groupBy(quote_key().alias("quote_key")).agg(F.max_by(F.struct(*fields), F.struct("updated", "american_odds")).alias("q"))
    return best.select("quote_key", "q.*")


def starter_identity_changes(captures: DataFrame) -> DataFrame:
    """Ordered distinct pitchers per (game, side) where they changed.

    ``captures``: game_pk, side, pitcher_id, captured_at.  Captures reduce to each pitcher's
    first time before the order is formed, so re-captures cost nothing.
    """
    first = captures.groupBy("game_pk", "side", "pitcher_id").agg(F.min("captured_at").alias("first_seen"), F.count(F.lit(1)).alias("n"))
    seen = first.groupBy("game_pk", "side").agg(F.sort_array(F.collect_list(F.struct("first_seen", "pitcher_id"))).alias("s"), F.sum("n").alias("captures"))
    ids = F.transform("s", lambda x: x["pitcher_id"].cast("string"))
    return seen.filter(F.size("s") > 1).select("game_pk", "side", F.array_join(ids, ">").alias("pitcher_ids"), "captures")


def capture_completeness(captures: DataFrame) -> DataFrame:
    """Games with captures on both sides, on one side, and pitchers seen."""
    sides = captures.groupBy("game_pk").agg((F.max(F.when(F.col("side") == "away", 1).otherwise(0)) + F.max(F.when(F.col("side") == "home", 1).otherwise(0))).alias("sides"))
    counts = sides.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("sides") == 2).alias("complete_games"), F.count_if(F.col("sides") < 2).alias("partial_games"))
    return counts

