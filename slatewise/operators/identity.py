"""Reconciling contests, schedules, quotes and histories across sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions.status import exclusion_reason, final_status, status_rank, was_played
from slatewise.operators.positions import neighbours

# How far apart a provider event and a contest may start
MATCH_SECONDS = 8 * 3600
COMPARED_FIELDS = ("a_runs", "b_runs", "team_a", "team_b", "game_date")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Fail when a key repeats; reads at most one offending key back."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{what}: key {[repeated[0][k] for k in keys]} is not unique")


def canonical_orientation(games: DataFrame) -> DataFrame:
    """Alphabetical team_a/team_b with runs and starters on the matching side."""
    home_first = F.col("home_team") < F.col("away_team")
    pick = lambda name, a: (F.when(home_first, F.col(f"home_{name}")).otherwise(F.col(f"away_{name}")) if a else F.when(home_first, F.col(f"away_{name}")).otherwise(F.col(f"home_{name}")))
    return games.select(
        "game_pk", "game_date", F.least("away_team", "home_team").alias("team_a"), F.greatest("away_team", "home_team").alias("team_b"),
        pick("runs", True).alias("a_runs"), pick("runs", False).alias("b_runs"), pick("starter", True).alias("a_starter"), pick("starter", False).alias("b_starter"),
        home_first.cast("int").alias("team_a_is_home"),
    )


def status_classify(schedule: DataFrame) -> DataFrame:
    a, d, c = F.col("status_abstract"), F.col("status_detailed"), F.col("status_code")
    return schedule.select("game_pk", "status_detailed", final_status(a, d, c).alias("status_class"), was_played(d, c).alias("was_played"))


def pregame_eligibility(schedule: DataFrame, captured: Column) -> DataFrame:
    reason = exclusion_reason(F.col("game_pk"), F.col("status_abstract"), F.col("status_detailed"), F.col("start_ts"), captured)
    return schedule.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def reciprocal_game_join(logs: DataFrame) -> DataFrame:
    """Contests rebuilt from team logs: both clubs' rows must exist with finite runs.

    A repeated (date, team, opponent) keeps its last row by ``log_order``.
    """
    fields = F.struct("teamruns", "teamstarter", "rundifferential")
    rows = logs.groupBy("log_date", "team", "opponent").agg(F.max_by(fields, "log_order").alias("r")).filter("r.teamruns is not null and not isnan(cast(r.teamruns as double))")
    a = rows.filter("team < opponent").select("log_date", F.col("team").alias("team_a"), F.col("opponent").alias("team_b"), F.col("r").alias("ra"))
    b = rows.filter("team > opponent").select("log_date", F.col("opponent").alias("team_a"), F.col("team").alias("team_b"), F.col("r").alias("rb"))
    joined = a.join(b, ["log_date", "team_a", "team_b"])
    return joined.select(
        F.col("log_date").alias("game_date"), "team_a", "team_b", F.col("ra.teamruns").alias("a_runs"), F.col("rb.teamruns").alias("b_runs"),
        (F.col("ra.teamruns") > F.col("rb.teamruns")).cast("int").alias("a_win"), F.col("ra.teamstarter").alias("a_starter"), F.col("rb.teamstarter").alias("b_starter"),
    )


def _pair() -> list[Column]:
    return ["game_date", F.least("away_team", "home_team").alias("team_a"), F.greatest("away_team", "home_team").alias("team_b")]


def schedule_attach(games: DataFrame, schedule: DataFrame) -> DataFrame:
    """Official id and home side for games whose date and teams name exactly one contest.

    No contest gives a missing flag; more than one is ambiguous and drops the game.
    """
    by_pair = schedule.groupBy(*_pair()).agg(F.count(F.lit(1)).alias("n"), F.min("game_pk").alias("game_pk"), F.min("home_team").alias("home"))
    joined = games.join(by_pair, ["game_date", "team_a", "team_b"], "left").filter("n is null or n = 1")
    return joined.withColumns(
        {
            "team_a_is_home": F.coalesce((F.col("home") == F.col("team_a")).cast("int"), F.lit(0)),
            "missing_home_away": F.col("n").isNull().cast("int"),
        }
    ).drop("n", "home")


def two_tier_key_join(rows: DataFrame, external: DataFrame, values: Sequence[str]) -> DataFrame:
    """Attach external values by game_pk, else by (date, team_a, team_b).

    ``matched_by`` tells which key hit.  A pair that names several external rows cannot be used
    without an id and comes back AMBIGUOUS.
    """
    pair = ["game_date", "team_a", "team_b"]
    payload = F.struct(*values)
    by_pk = external.filter("game_pk is not null").groupBy("game_pk").agg(F.max(payload).alias("pk_hit"))
    by_pair = external.groupBy(*pair).agg(F.max(payload).alias("pair_hit"), F.count(F.lit(1)).alias("pair_n"))
    joined = rows.join(by_pk, "game_pk", "left").join(by_pair, pair, "left")
    single = F.when(F.col("pair_n") == 1, F.col("pair_hit"))
    hit = F.coalesce("pk_hit", single)
    how = F.when(F.col("pk_hit").isNotNull(), "GAME_PK").when(F.col("pair_n") == 1, "DATE_TEAMS").when(F.col("pair_n") > 1, "AMBIGUOUS").otherwise("NONE")
    return joined.select(*rows.columns, *[hit[v].alias(v) for v in values], how.alias("matched_by"))


def quote_context_match(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """Match typed lines (line_id, game_pk?, date, teams) to official contests.

    An id must agree on date and teams; without one the date and teams must name one contest.
    The first line of a contest keeps it, later ones are duplicates.
    """
    natural = ["game_date", "away_team", "home_team"]
    ids = contexts.select("game_pk", F.struct(*natural).alias("official"))
    by_name = contexts.groupBy(*natural).agg(F.count(F.lit(1)).alias("n"), F.min("game_pk").alias("only_pk"))
    joined = lines.join(ids, "game_pk", "left").join(by_name, natural, "left")
    has_id = F.col("game_pk").isNotNull()
    agrees = F.col("official") == F.struct(*natural)
    error = (
        F.when(has_id & F.col("official").isNull(), "game_pk_not_found")
        .when(has_id & ~agrees, "game_pk_mismatch")
        .when(~has_id & F.col("n").isNull(), "no_match")
        .when(~has_id & (F.col("n") > 1), "ambiguous_doubleheader")
    )
    rows = joined.withColumn("error", error)
    rows = rows.withColumn("matched_pk", F.when(F.col("error").isNull(), F.coalesce("game_pk", "only_pk")))
    first = rows.filter("matched_pk is not null").groupBy("matched_pk").agg(F.min("line_id").alias("first_line"))
    rows = rows.join(first, "matched_pk", "left")
    late = F.col("line_id") > F.col("first_line")
    return rows.select(
        "line_id", F.when(late, F.lit(None)).otherwise(F.col("matched_pk")).alias("matched_pk"), F.when(late, "duplicate_input").otherwise(F.col("error")).alias("error")
    )


def nearest_event_match(events: DataFrame, contexts: DataFrame, tolerance: int = MATCH_SECONDS) -> DataFrame:
    """The contest of the same teams that starts nearest to each provider event.

    Events: event_id, away_team, home_team, commence (epoch seconds or NULL).  Contexts: game_pk,
    away_team, home_team, start (epoch seconds or NULL).  Starts and events of a pair are merged in time order
    and an event sees the last start before it and the next one after it, so it meets two starts however many the
    pair has; contests starting together count once.  A tie at the least distance stays unmatched; a pair with one
    contest in all is accepted when either time is unknown.
    """
    teams = ["away_team", "home_team"]
    times = contexts.filter("start is not null").groupBy(*teams, "start").agg(F.count(F.lit(1)).alias("same"), F.min("game_pk").alias("pk"))
    starts = times.select(*teams, F.col("start").alias("time"), F.struct("start", "same", "pk").alias("begins"))
    asked = events.filter("commence is not null").select(*teams, F.col("commence").alias("time"), "event_id")
    merged = starts.unionByName(asked, allowMissingColumns=True)
    # a start comes before the events of its time
    order = [F.col("time"), F.col("event_id").isNotNull(), F.col("event_id")]
    seen = neighbours(merged, teams, order, F.col("begins")).filter("event_id is not null")
    gap = lambda side: F.abs(F.col(f"{side}.start") - F.col("time"))
    nearest = F.least(gap("_last"), gap("_next"))
    here = lambda side: F.coalesce(gap(side) == nearest, F.lit(False))
    ties = F.when(here("_last"), F.col("_last.same")).otherwise(0) + F.when(here("_next"), F.col("_next.same")).otherwise(0)
    pk = F.when(here("_last"), F.col("_last.pk")).otherwise(F.col("_next.pk"))
    best = seen.filter(nearest <= tolerance).select("event_id", F.struct(nearest.alias("gap"), ties.alias("ties"), pk.alias("pk")).alias("b"))
    best = best.groupBy("event_id").agg(F.min_by("b", "b.gap").alias("b"))
    only = contexts.groupBy(*teams).agg(F.count(F.lit(1)).alias("all"), F.min("game_pk").alias("only_pk"), F.max("start").alias("only_start"))
    rows = events.join(best, "event_id", "left").join(only, teams, "left")
    unknown_time = F.col("commence").isNull() | F.col("only_start").isNull()
    matched = F.when((F.col("all") == 1) & unknown_time, F.col("only_pk")).when(F.col("b.ties") == 1, F.col("b.pk"))
    return rows.select("event_id", matched.alias("game_pk"), F.col("b.gap").alias("gap"), matched.isNotNull().alias("matched"))


def one_to_one_compare_join(production: DataFrame, shadow: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """Production rows with every shadow column prefixed, disagreement and probability advantage.

    Both sides must hold the same keys exactly once.
    """
    require_unique(production, [key], "production")
    require_unique(shadow, [key], "shadow")
    if frame_equality_check(production, shadow, [key]).first()["identical"] is False:
        raise ValueError("production and shadow must hold the same contests")
    own = [c for c in shadow.columns if c != key and c not in shared]
    right = shadow.select(key, *[F.col(c).alias(f"shadow_{c}") for c in own])
    return production.join(right, key).withColumns(
        {
            "disagree": ~F.col("pick").eqNullSafe(F.col("shadow_pick")),
            "shadow_advantage": F.col("shadow_pick_probability") - F.col("pick_probability"),
        }
    )


def frame_equality_check(left: DataFrame, right: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Do two frames hold the same identity rows, counting repeats, regardless of order."""
    signed = left.select(*identity, F.lit(1).alias("_s")).unionByName(right.select(*identity, F.lit(-1).alias("_s")))
    balance = signed.groupBy(*identity).agg(F.sum("_s").alias("_s"))
    totals = balance.agg(
        F.coalesce(F.sum(F.greatest("_s", F.lit(0))), F.lit(0)).alias("left_only"), F.coalesce(F.sum(F.greatest(-F.col("_s"), F.lit(0))), F.lit(0)).alias("right_only")
    )
    return totals.withColumn("identical", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def history_upsert(cached: DataFrame, fetched: DataFrame, through: str) -> DataFrame:
    """Cached finals updated with freshly fetched ones, up to a date.

    The same teams under one id take the fetched row (RECONCILED when it differs); changed teams
    are a CONFLICT and keep the cached row; unknown ids are INSERTED.
    """
    fields = [c for c in cached.columns if c != "game_pk"]
    old = cached.select("game_pk", F.struct(*fields).alias("old"))
    new = fetched.select("game_pk", F.struct(*fields).alias("new"))
    same_teams = (F.col("old.team_a") == F.col("new.team_a")) & (F.col("old.team_b") == F.col("new.team_b"))
    differs = ~F.struct(*[F.col(f"old.{c}") for c in COMPARED_FIELDS]).eqNullSafe(F.struct(*[F.col(f"new.{c}") for c in COMPARED_FIELDS]))
    action = (
        F.when(F.col("new").isNull(), "KEPT").when(F.col("old").isNull(), "INSERTED").when(~same_teams, "CONFLICT").when(differs, "RECONCILED").otherwise("UNCHANGED")
    )
    merged = old.join(new, "game_pk", "full_outer").withColumn("action", action)
    row = F.when(F.col("action").isin("KEPT", "CONFLICT"), F.col("old")).otherwise(F.col("new"))
    final = merged.select("game_pk", "action", row.alias("r")).select("game_pk", "action", "r.*")
    return final.filter(F.col("game_date") <= F.lit(through).cast("date"))


def history_conflicts(rows: DataFrame) -> DataFrame:
    """Ids that carry more than one score, team or date."""
    spread = rows.groupBy("game_pk").agg(F.count(F.lit(1)).alias("rows"), *[(F.min(c) != F.max(c)).alias(f"{c}_differs") for c in COMPARED_FIELDS])
    any_differs = F.lit(False)
    for c in COMPARED_FIELDS:
        any_differs = any_differs | F.coalesce(F.col(f"{c}_differs"), F.lit(False))
    return spread.filter(any_differs)


def history_union(base: DataFrame, cache: DataFrame) -> DataFrame:
    """Base and cache by column name: one row per id (latest date, cache first), rows without id kept."""
    both = base.withColumn("_src", F.lit(0)).unionByName(cache.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("_src", "game_pk")]
    with_id = both.filter("game_pk is not null").groupBy("game_pk").agg(F.max_by(F.struct(*fields), F.struct("game_date", "_src")).alias("r")).select("game_pk", "r.*")
    return with_id.unionByName(both.filter("game_pk is null").drop("_src"))


def ready_blocked_union(evaluated: DataFrame, blocked: DataFrame) -> DataFrame:
    """Evaluated rows plus blocked contests as PASS rows that can never be picked."""
    passed = blocked.withColumns({"selection_status": F.lit("PASS"), "eligible_for_top_pick": F.lit(False), "is_top_pick": F.lit(False)})
    return evaluated.unionByName(passed, allowMissingColumns=True)


def backfill_gap(schedule: DataFrame, built: DataFrame) -> DataFrame:
    """Played contests that have no built rows yet."""
    played = schedule.filter(was_played(F.col("status_detailed"), F.col("status_code")))
    return played.select("game_pk", "game_date").join(built.select("game_pk"), "game_pk", "left_anti")


def changed_game_antijoin(eligible: DataFrame, snapshots: DataFrame, simulations: int, prices_changed: bool, force: bool = False) -> DataFrame:
    """Which contests need a new evaluation and the status of the whole publication.

    Snapshots: game_pk, track, input_hash, simulations, created_at.  A contest is current when the
    latest snapshot of both tracks carries its input hash and simulation count.
    """
    latest = snapshots.groupBy("game_pk", "track").agg(F.max_by(F.struct("input_hash", "simulations"), "created_at").alias("s"))
    joined = eligible.join(latest, "game_pk", "left")
    good = (F.col("s.input_hash") == F.col("input_hash")) & (F.col("s.simulations") == simulations)
    rows = joined.groupBy("game_pk").agg(F.count_if(good).alias("current_tracks"))
    return rows.withColumn("changed", (F.col("current_tracks") < 2) | F.lit(force))


def publication_status(changed: DataFrame, prices_changed: bool) -> DataFrame:
    n, c = F.count(F.lit(1)), F.count_if(F.col("changed"))
    status = F.when(n == 0, "NO_PREGAME_GAMES").when(c > 0, "PASS").otherwise("PRICES_UPDATED" if prices_changed else "SKIPPED_UNCHANGED")
    return changed.agg(n.alias("games"), c.alias("changed_games"), status.alias("status"))


def schedule_dedupe_merge(feed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One record per id from a feed that repeats ids.

    Each field comes from the most advanced, most complete, latest record that holds it; a change
    of teams is reported as a conflict.
    """
    completeness = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in fields), F.lit(0))
    order = F.struct(status_rank(F.col("status_abstract"), F.col("status_detailed")), completeness, F.col("arrival"))
    present = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)
    carried = ["game_date", "away_team", "home_team", "status_abstract", "status_detailed", *fields]
    return feed.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("records"), *[F.max_by(c, present(c)).alias(c) for c in carried],
        ((F.min("away_team") != F.max("away_team")) | (F.min("home_team") != F.max("home_team"))).alias("team_conflict"),
    )


# Columns that record how a row travelled, not what it says
TRANSPORT_SUFFIXES = ("_snapshot_path", "_snapshot_sha256")
TRANSPORT_COLUMNS = ("provenance",)


def row_fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """SHA-256 per row over its named fields in name order, transport columns left out."""
    kept = sorted(c for c in rows.columns if c != key and c not in TRANSPORT_COLUMNS and not c.endswith(TRANSPORT_SUFFIXES))
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in kept]
    return rows.select(key, F.sha2(F.concat_ws("|", F.concat(F.lit(f"{key}="), F.col(key).cast("string")), *named), 256).alias("fingerprint"))


def table_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """One order-free fingerprint of a table: row count and the sums of the digests' six lanes, merged map-side."""
    lanes = [F.sum(F.conv(F.substring("fingerprint", at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in range(1, 64, 12)]
    sums = fingerprints.agg(F.count(F.lit(1)).alias("rows"), *lanes)
    return sums.select("rows", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("fingerprint"))


def _lanes(digest: Column, sign: Column | int = 1) -> list[Column]:
    """Order-free sums of a digest's six lanes: a set of rows has the same sums in any order."""
    return [F.sum(sign * F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in range(1, 64, 12)]


LANES = [f"s{at}" for at in range(1, 64, 12)]


def _line_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in fields]), 256)


def context_fingerprint(games: DataFrame, rosters: DataFrame, transactions: DataFrame, stable: Sequence[str]) -> DataFrame:
    """(game_pk, fingerprint): what the rosters and transactions of a game's two teams and its stable fields say.

    Games: game_pk, home_team, away_team and the fields of ``stable``.  Rosters: team, captured_at, file_path and
    players, an array of structs; the latest capture of a team counts, whatever the order of its players.
    Transactions: transaction_id, from_team, to_team and payload, a struct; repeated deliveries count once.  Capture times
    and paths take no part, so an unchanged capture keeps the fingerprint.  Teams' sums are joined, never their
    lists: a game holds both teams' transactions less those between them, which both have.
    """
    players = rosters.groupBy("team").agg(F.max_by("players", F.struct("captured_at", "file_path")).alias("players"))
    one = F.transform("players", lambda p: F.sha2(F.to_json(p), 256))
    roster = players.select("team", F.sha2(F.array_join(F.array_sort(one), ","), 256).alias("roster"))

    moves = transactions.select("transaction_id", "from_team", "to_team", _line_digest([F.col("transaction_id"), F.col("from_team"), F.col("to_team"), F.to_json("payload")]).alias("digest"))
    moves = moves.dropDuplicates(["digest"])
    sides = moves.select(F.explode(F.array_distinct(F.array_compact(F.array("from_team", "to_team")))).alias("team"), "digest")
    by_team = sides.groupBy("team").agg(*_lanes(F.col("digest")), F.count(F.lit(1)).alias("moves"))
    inner = moves.where("from_team <> to_team").groupBy(F.least("from_team", "to_team").alias("low"), F.greatest("from_team", "to_team").alias("high"))
    between = inner.agg(*_lanes(F.col("digest")), F.count(F.lit(1)).alias("moves"))

    team = roster.join(by_team, "team", "full")
    rows = games.withColumns({"low": F.least("home_team", "away_team"), "high": F.greatest("home_team", "away_team")})
    for side in ("low", "high"):
        rows = rows.join(team.select(F.col("team").alias(side), F.struct("roster", *LANES, "moves").alias(f"of_{side}")), side, "left")
    rows = rows.join(between.select("low", "high", F.struct(*LANES, "moves").alias("of_both")), ["low", "high"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = lambda name: zero(F.col(f"of_low.{name}")) + zero(F.col(f"of_high.{name}")) - zero(F.col(f"of_both.{name}"))
    parts = [F.col(c) for c in sorted(stable)] + [F.col("low"), F.col("of_low.roster"), F.col("high"), F.col("of_high.roster"), *[total(c) for c in (*LANES, "moves")]]
    return rows.select("game_pk", _line_digest(parts).alias("fingerprint"))
