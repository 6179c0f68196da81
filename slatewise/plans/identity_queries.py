"""Reconciliation queries over contests, schedules, logs and typed lines."""

from pyspark.sql import functions as F

from slatewise.operators import identity, ledger
from slatewise.plans.registry import query


@query(
    "canonical_orientation",
    "game_pk:i game_date:s team_a:s team_b:s a_runs:i b_runs:i a_starter:s b_starter:s team_a_is_home:i",
    "=> select * from contests",
)
def canonical_orientation(t):
    return identity.canonical_orientation(t.schedule)


FINAL_SQL = "(status_abstract = 'Final' or status_detailed like 'Final%' or status_detailed in ('Game Over', 'Completed Early') or status_code in ('F', 'O'))"
OFF_SQL = "regexp_matches(lower(status_detailed), 'postpon|cancel|suspend')"
PLAYED_SQL = "((status_detailed like 'Final%' or status_detailed in ('Game Over', 'Completed Early') or status_code in ('F', 'O')) and not regexp_matches(lower(status_detailed), 'postpon|cancel|suspend|resched|scheduled'))"


@query(
    "status_classify",
    "game_pk:i status_detailed:s status_class:s was_played:b",
    f"=> select game_pk, status_detailed, case when {OFF_SQL} then 'NON_BLOCKING' when {FINAL_SQL} then 'FINAL' else 'BLOCKING' end as status_class, {PLAYED_SQL} as was_played from schedule",
)
def status_classify(t):
    return identity.status_classify(t.schedule)


@query(
    "pregame_eligibility",
    "game_pk:i reason:s eligible:b",
    """r as (select case when priority = '5-LOW' then null else game_pk end as game_pk, game_pk as k, game_date, start_ts, lower(status_abstract || ' ' || status_detailed) as st from schedule),
    e as (select *, case when game_pk is null then 'missing_game_pk' when regexp_matches(st, 'final|completed|game over|cancelled|canceled|postponed|suspended|in progress|live') then 'status:' || st
      when start_ts is null then 'missing_game_time' when game_date + interval 15 hour >= start_ts then 'scheduled_start_reached' end as reason from r)
    => select game_pk, reason, reason is null as eligible from e""",
)
def pregame_eligibility(t):
    rows = t.schedule.withColumn("game_pk", F.when(F.col("priority") != "5-LOW", F.col("game_pk")))
    return identity.pregame_eligibility(rows, F.expr("cast(game_date as timestamp_ntz) + interval '15' hour"))


REBUILT = """
l as (select * from team_logs qualify row_number() over (partition by log_date, team, opponent order by log_order desc) = 1),
rebuilt as (select a.log_date as game_date, a.team as team_a, a.opponent as team_b, a.teamruns as a_runs, b.teamruns as b_runs, case when a.teamruns > b.teamruns then 1 else 0 end as a_win,
  a.teamstarter as a_starter, b.teamstarter as b_starter from l a join l b on a.log_date = b.log_date and a.team = b.opponent and a.opponent = b.team where a.team < b.team)
"""


@query("reciprocal_game_join", "game_date:s team_a:s team_b:s a_runs:i b_runs:i a_win:i a_starter:s b_starter:s", f"{REBUILT} => select * from rebuilt")
def reciprocal_game_join(t):
    return identity.reciprocal_game_join(t.team_logs)


@query(
    "schedule_attach",
    "game_date:s team_a:s team_b:s a_runs:i game_pk:i team_a_is_home:i missing_home_away:i",
    f"""{REBUILT}, s as (select * from schedule where feed_status <> 'P')
    => select r.*, s.game_pk, case when s.home_team = r.team_a then 1 else 0 end as team_a_is_home, case when s.game_pk is null then 1 else 0 end as missing_home_away
       from rebuilt r left join s on s.game_date = r.game_date and least(s.away_team, s.home_team) = r.team_a and greatest(s.away_team, s.home_team) = r.team_b
       where (select count(*) from s x where x.game_date = r.game_date and least(x.away_team, x.home_team) = r.team_a and greatest(x.away_team, x.home_team) = r.team_b) <= 1""",
)
def schedule_attach(t):
    return identity.schedule_attach(identity.reciprocal_game_join(t.team_logs), t.schedule.filter("feed_status <> 'P'"))


@query(
    "two_tier_key_join",
    "row_id:i baseline_probability:d matched_by:s",
    """rows as (select c.game_pk as row_id, case when c.priority not in ('5-LOW', '4-NOT SPECIFIED') then c.game_pk end as game_pk, c.game_date, c.team_a, c.team_b from contests c),
    ext as (select case when c.feed_status <> 'O' then p.game_pk end as game_pk, p.game_date, p.team_a, p.team_b, p.baseline_probability from predictions p join contests c using (game_pk) where c.feed_status <> 'P'),
    pairs as (select game_date, team_a, team_b, count(*) as n, max(baseline_probability) as v from ext group by all)
    => select row_id, case when e.baseline_probability is not null then e.baseline_probability when n = 1 then v end as baseline_probability,
       case when e.baseline_probability is not null then 'GAME_PK' when n = 1 then 'DATE_TEAMS' when n > 1 then 'AMBIGUOUS' else 'NONE' end as matched_by
       from rows r left join (select game_pk, max(baseline_probability) as baseline_probability from ext where game_pk is not null group by game_pk) e on e.game_pk = r.game_pk
       left join pairs p on p.game_date = r.game_date and p.team_a = r.team_a and p.team_b = r.team_b""",
)
def two_tier_key_join(t):
    known = F.when(~F.col("priority").isin("5-LOW", "4-NOT SPECIFIED"), F.col("game_pk"))
    rows = t.contests.select(F.col("game_pk").alias("row_id"), known.alias("game_pk"), "game_date", "team_a", "team_b")
    external = t.predictions.join(t.contests.select("game_pk", "feed_status"), "game_pk").filter("feed_status <> 'P'")
    external = external.withColumn("game_pk", F.when(F.col("feed_status") != "O", F.col("game_pk")))
    return identity.two_tier_key_join(rows, external, ["baseline_probability"])


@query(
    "quote_context_match",
    "line_id:i matched_pk:i error:s",
    """lines as (select game_pk * 2 as line_id, case when priority = '5-LOW' then null when priority = '4-NOT SPECIFIED' and feed_status = 'P' then game_pk + 1000000000000 else game_pk end as pk,
        case when priority = '3-MEDIUM' and feed_status = 'O' then away_team else home_team end as home, away_team, game_date from schedule
      union all select game_pk * 2 + 1, game_pk, home_team, away_team, game_date from schedule where priority = '2-HIGH' and feed_status = 'F'
      union all select game_pk * 2 + 1, null, 'T' || home_team, away_team, game_date from schedule where priority = '5-LOW' and feed_status = 'O'),
    m as (select l.*, s.game_pk as hit, s.game_date = l.game_date and s.away_team = l.away_team and s.home_team = l.home as agrees,
      (select count(*) from schedule x where x.game_date = l.game_date and x.away_team = l.away_team and x.home_team = l.home) as n,
      (select min(game_pk) from schedule x where x.game_date = l.game_date and x.away_team = l.away_team and x.home_team = l.home) as only_pk from lines l left join schedule s on s.game_pk = l.pk),
    e as (select *, case when pk is not null and hit is null then 'game_pk_not_found' when pk is not null and not agrees then 'game_pk_mismatch' when pk is null and n = 0 then 'no_match' when pk is null and n > 1 then 'ambiguous_doubleheader' end as err from m),
    f as (select *, case when err is null then coalesce(pk, only_pk) end as mp from e),
    g as (select *, mp is not null and row_number() over (partition by mp order by line_id) > 1 as late from f)
    => select line_id, case when not late then mp end as matched_pk, case when late then 'duplicate_input' else err end as error from g""",
)
def quote_context_match(t):
    s = t.schedule
    pk = F.when(F.col("priority") == "5-LOW", None).when((F.col("priority") == "4-NOT SPECIFIED") & (F.col("feed_status") == "P"), F.col("game_pk") + 1000000000000).otherwise(F.col("game_pk"))
    home = F.when((F.col("priority") == "3-MEDIUM") & (F.col("feed_status") == "O"), F.col("away_team")).otherwise(F.col("home_team"))
    cut = lambda rows, k, pk, home: rows.select((F.col("game_pk") * 2 + k).alias("line_id"), pk.cast("long").alias("game_pk"), "game_date", "away_team", home.alias("home_team"))
    lines = cut(s, 0, pk, home)
    lines = lines.unionByName(cut(s.filter("priority = '2-HIGH' and feed_status = 'F'"), 1, F.col("game_pk"), F.col("home_team")))
    lines = lines.unionByName(cut(s.filter("priority = '5-LOW' and feed_status = 'O'"), 1, F.lit(None), F.concat(F.lit("T"), F.col("home_team"))))
    return identity.quote_context_match(lines, s.select("game_pk", "game_date", "away_team", "home_team"))


@query(
    "nearest_event_match",
    "event_id:i game_pk:i gap:i matched:b",
    """ctx as (select game_pk, away_team, home_team, epoch(start_ts) as start from schedule),
    ev as (select game_pk as event_id, away_team, home_team, case when priority = '4-NOT SPECIFIED' then null else epoch(cast(game_date as timestamp)) + 3600 * (12 + game_pk % 11) + 1800 * ((game_pk % 37) - 18) end as commence from schedule),
    c as (select event_id, game_pk, abs(start - commence) as gap from ev join ctx using (away_team, home_team) where abs(start - commence) <= 28800),
    b as (select event_id, min(gap) as gap, count(*) filter (where gap = g) as ties, min(game_pk) filter (where gap = g) as pk from (select *, min(gap) over (partition by event_id) as g from c) x group by event_id),
    only_one as (select away_team, home_team, count(*) as n, min(game_pk) as pk, max(start) as st from ctx group by all),
    r as (select ev.event_id, b.gap, case when n = 1 and (commence is null or st is null) then o.pk when b.ties = 1 then b.pk end as game_pk from ev left join b using (event_id) left join only_one o using (away_team, home_team))
    => select *, game_pk is not null as matched from r""",
)
def nearest_event_match(t):
    contexts = t.schedule.select("game_pk", "away_team", "home_team", F.unix_timestamp(F.col("start_ts").cast("timestamp")).alias("start"))
    day = F.unix_timestamp(F.col("game_date").cast("timestamp"))
    commence = F.when(F.col("priority") != "4-NOT SPECIFIED", day + 3600 * (12 + F.col("game_pk") % 11) + 1800 * (F.col("game_pk") % 37 - 18))
    events = t.schedule.select(F.col("game_pk").alias("event_id"), "away_team", "home_team", commence.alias("commence"))
    return identity.nearest_event_match(events, contexts)


def _track(t, column):
    p = F.col(column)
    return ledger.latest_predictions(t.ledger).select(
        "game_pk", "away_team", "home_team", F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team")).alias("pick"), F.greatest(p, 1 - p).alias("pick_probability")
    )


@query(
    "one_to_one_compare_join",
    "game_pk:i pick:s pick_probability:d shadow_pick:s shadow_pick_probability:d disagree:b shadow_advantage:d",
    """p as (select game_pk, case when production_home_probability >= 0.5 then home_team else away_team end as pick, greatest(production_home_probability, 1 - production_home_probability) as pick_probability,
      case when home_probability >= 0.5 then home_team else away_team end as shadow_pick, greatest(home_probability, 1 - home_probability) as shadow_pick_probability from last_predictions where true)
    => select *, pick <> shadow_pick as disagree, shadow_pick_probability - pick_probability as shadow_advantage from p""",
)
def one_to_one_compare_join(t):
    return identity.one_to_one_compare_join(_track(t, "production_home_probability"), _track(t, "home_probability"), "game_pk", ["away_team", "home_team"])


@query(
    "frame_equality_check",
    "left_only:i right_only:i identical:b",
    """a as (select game_date, team_a, team_b, a_win from contests), b as (select game_date, team_a, team_b, a_win from predictions where team_a_is_home = 1 or a_win = 1)
    , c as (select (select count(*) from (select * from a except all select * from b)) as left_only, (select count(*) from (select * from b except all select * from a)) as right_only)
    => select *, left_only = 0 and right_only = 0 as identical from c""",
)
def frame_equality_check(t):
    return identity.frame_equality_check(t.contests, t.predictions.filter("team_a_is_home = 1 or a_win = 1"), ["game_date", "team_a", "team_b", "a_win"])


UPSERT = """
cached as (select game_pk, game_date, team_a, case when priority = '2-HIGH' then 'T99' else team_b end as team_b, case when priority = '1-URGENT' then a_runs + 1 else a_runs end as a_runs, b_runs from contests where feed_status in ('F', 'O')),
fetched as (select game_pk, game_date, team_a, team_b, a_runs, b_runs from contests where feed_status in ('F', 'P'))
"""


def _cached_fetched(t):
    columns = ["game_pk", "game_date", "team_a", "team_b", "a_runs", "b_runs"]
    old = t.contests.filter("feed_status in ('F', 'O')")
    old = old.withColumns(
        {
            "team_b": F.when(F.col("priority") == "2-HIGH", "T99").otherwise(F.col("team_b")),
            "a_runs": F.when(F.col("priority") == "1-URGENT", F.col("a_runs") + 1).otherwise(F.col("a_runs")),
        }
    )
    return old.select(*columns), t.contests.filter("feed_status in ('F', 'P')").select(*columns)


@query(
    "history_upsert",
    "game_pk:i action:s game_date:s team_a:s team_b:s a_runs:i b_runs:i",
    f"""{UPSERT}, j as (select coalesce(c.game_pk, f.game_pk) as game_pk, case when f.game_pk is null then 'KEPT' when c.game_pk is null then 'INSERTED' when c.team_b <> f.team_b then 'CONFLICT' when c.a_runs <> f.a_runs then 'RECONCILED' else 'UNCHANGED' end as action,
      coalesce(c.game_date, f.game_date) as game_date, coalesce(c.team_a, f.team_a) as team_a, coalesce(c.team_b, f.team_b) as team_b, c.a_runs as ca, f.a_runs as fa, coalesce(c.b_runs, f.b_runs) as b_runs from cached c full join fetched f on c.game_pk = f.game_pk)
    => select *, case when action in ('KEPT', 'CONFLICT') then ca else fa end as a_runs from j where game_date <= date '2001-06-30'""",
)
def history_upsert(t):
    return identity.history_upsert(*_cached_fetched(t), "2001-06-30")


@query(
    "history_conflicts",
    "game_pk:i rows:i a_runs_differs:b team_b_differs:b",
    f"""{UPSERT}, u as (select * from cached union all select * from fetched)
    => select game_pk, count(*) as rows, count(distinct a_runs) > 1 as a_runs_differs, count(distinct team_b) > 1 as team_b_differs from u group by game_pk having count(distinct a_runs) > 1 or count(distinct team_b) > 1""",
)
def history_conflicts(t):
    cached, fetched = _cached_fetched(t)
    return identity.history_conflicts(cached.unionByName(fetched))


@query(
    "history_union",
    "game_pk:i game_date:s team_a:s team_b:s a_runs:i origin:s",
    """b as (select case when priority <> '5-LOW' then game_pk end as game_pk, game_date, team_a, team_b, a_runs from contests where feed_status <> 'O'),
    c as (select game_pk, case when priority = '1-URGENT' then game_date - 2 else game_date end as game_date, team_a, team_b, a_runs + 1 as a_runs, 'cache' as origin from contests where feed_status <> 'F'),
    u as (select *, null as origin, 0 as src from b union all by name select *, 1 as src from c)
    => select * from u qualify game_pk is null or row_number() over (partition by game_pk order by game_date desc, src desc) = 1""",
)
def history_union(t):
    columns = ["game_pk", "game_date", "team_a", "team_b", "a_runs"]
    base = t.contests.filter("feed_status <> 'O'").withColumn("game_pk", F.when(F.col("priority") != "5-LOW", F.col("game_pk"))).select(*columns)
    day = F.when(F.col("priority") == "1-URGENT", F.date_sub("game_date", 2)).otherwise(F.col("game_date"))
    cache = t.contests.filter("feed_status <> 'F'").withColumns({"game_date": day, "a_runs": F.col("a_runs") + 1, "origin": F.lit("cache")}).select(*columns, "origin")
    return identity.history_union(base, cache)


@query(
    "ready_blocked_union",
    "game_pk:i home_probability:d selection_status:s eligible_for_top_pick:b is_top_pick:b",
    """=> select game_pk, home_probability, selection_status, selection_status = 'ELIGIBLE' as eligible_for_top_pick, selection_status = 'ELIGIBLE' and home_probability > 0.9 as is_top_pick from last_predictions where true and selection_status <> 'BLOCKED'
    union all select game_pk, null, 'PASS', false, false from last_predictions where true and selection_status = 'BLOCKED'""",
)
def ready_blocked_union(t):
    first = ledger.latest_predictions(t.ledger)
    ok = F.col("selection_status") == "ELIGIBLE"
    done = first.filter("selection_status <> 'BLOCKED'").select(
        "game_pk", "home_probability", "selection_status", ok.alias("eligible_for_top_pick"), (ok & (F.col("home_probability") > 0.9)).alias("is_top_pick")
    )
    return identity.ready_blocked_union(done, first.filter("selection_status = 'BLOCKED'").select("game_pk"))


@query(
    "backfill_gap",
    "game_pk:i game_date:s",
    f"=> select game_pk, game_date from schedule where {PLAYED_SQL} and game_pk not in (select game_pk from appearances where is_starter = 0)",
)
def backfill_gap(t):
    return identity.backfill_gap(t.schedule, t.appearances.filter("is_starter = 0"))


SNAPSHOTS = """
el as (select game_pk, md5(cast(game_pk as varchar)) as input_hash from schedule where feed_status = 'O'),
sn as (select game_pk, track, case when priority = '1-URGENT' and track = 'shadow' then 'old' else md5(cast(game_pk as varchar)) end as input_hash, case when priority = '2-HIGH' then 5000 else 100000 end as simulations
  from schedule cross join (values ('production'), ('shadow')) v(track) where not (priority = '3-MEDIUM' and track = 'shadow'))
"""


def _changed(t):
    eligible = t.schedule.filter("feed_status = 'O'").select("game_pk", F.md5(F.col("game_pk").cast("string")).alias("input_hash"))
    snapshots = t.schedule.select(
        "game_pk", "priority", F.explode(F.array(F.lit("production"), F.lit("shadow"))).alias("track"), F.col("game_date").alias("created_at")
    ).filter("not (priority = '3-MEDIUM' and track = 'shadow')")
    stale = (F.col("priority") == "1-URGENT") & (F.col("track") == "shadow")
    snapshots = snapshots.withColumns(
        {
            "input_hash": F.when(stale, "old").otherwise(F.md5(F.col("game_pk").cast("string"))),
            "simulations": F.when(F.col("priority") == "2-HIGH", 5000).otherwise(100000),
        }
    )
    return identity.changed_game_antijoin(eligible, snapshots, 100000, False)


@query(
    "changed_game_antijoin",
    "game_pk:i current_tracks:i changed:b",
    f"""{SNAPSHOTS}, g as (select el.game_pk, count(*) filter (where sn.input_hash = el.input_hash and simulations = 100000) as current_tracks from el left join sn using (game_pk) group by el.game_pk)
    => select *, current_tracks < 2 as changed from g""",
)
def changed_game_antijoin(t):
    return _changed(t)


@query(
    "publication_status",
    "games:i changed_games:i status:s",
    f"""{SNAPSHOTS}, g as (select el.game_pk, count(*) filter (where sn.input_hash = el.input_hash and simulations = 100000) < 2 as changed from el left join sn using (game_pk) group by el.game_pk)
    => select count(*) as games, count(*) filter (where changed) as changed_games, case when count(*) = 0 then 'NO_PREGAME_GAMES' when count(*) filter (where changed) > 0 then 'PASS' else 'SKIPPED_UNCHANGED' end as status from g""",
)
def publication_status(t):
    return identity.publication_status(_changed(t), False)


@query(
    "schedule_dedupe_merge",
    "game_pk:i records:i game_date:s away_team:s home_team:s status_detailed:s away_pitcher:s home_pitcher:s venue_name:s team_conflict:b",
    """r as (select *, case when lower(status_abstract) like '%final%' or lower(status_detailed) like '%final%' or lower(status_detailed) like '%completed%' then 4 when status_abstract = 'Live' then 3 else 2 end as rk,
      (case when away_pitcher is null then 0 else 1 end) + (case when home_pitcher is null then 0 else 1 end) + (case when venue_name is null then 0 else 1 end) as full_n from schedule_feed),
    o as (select *, row_number() over (partition by game_pk order by rk desc, full_n desc, arrival desc) as k from r)
    => select game_pk, count(*) as records, max(game_date) filter (where k = 1) as game_date, max(away_team) filter (where k = 1) as away_team, max(home_team) filter (where k = 1) as home_team, max(status_detailed) filter (where k = 1) as status_detailed,
       coalesce(max(away_pitcher) filter (where k = 1), max(away_pitcher) filter (where k = 2)) as away_pitcher, coalesce(max(home_pitcher) filter (where k = 1), max(home_pitcher) filter (where k = 2)) as home_pitcher,
       coalesce(max(venue_name) filter (where k = 1), max(venue_name) filter (where k = 2)) as venue_name, count(distinct home_team) > 1 as team_conflict from o group by game_pk""",
)
def schedule_dedupe_merge(t):
    return identity.schedule_dedupe_merge(t.schedule_feed, ["away_pitcher", "home_pitcher", "venue_name"])


PRINT = """f as (select game_pk, sha256('game_pk=' || game_pk || '|a_runs=' || a_runs || '|a_starter=' || a_starter || '|b_runs=' || b_runs || '|b_starter=' || b_starter || '|team_a=' || team_a || '|team_b=' || team_b) as fingerprint from contests)"""
LANES = ", ".join(f"sum(cast('0x' || substr(fingerprint, {12 * i + 1}, 12) as bigint)) as s{i}" for i in range(6))
PRINTED = ["game_pk", "team_a", "team_b", "a_runs", "b_runs", "a_starter", "b_starter"]


@query("row_fingerprint", "game_pk:i fingerprint:s", f"{PRINT} => select * from f")
def row_fingerprint(t):
    return identity.row_fingerprint(t.contests.select(*PRINTED), "game_pk")


@query(
    "table_fingerprint",
    "rows:i fingerprint:s",
    f"{PRINT}, s as (select count(*) as rows, {LANES} from f) => select rows, sha256(concat_ws(':', rows, s0, s1, s2, s3, s4, s5)) as fingerprint from s",
)
def table_fingerprint(t):
    return identity.table_fingerprint(identity.row_fingerprint(t.contests.select(*PRINTED), "game_pk"))


MOVE_LANES = ", ".join(f"sum(cast('0x' || substr(d, {12 * i + 1}, 12) as hugeint)) as s{i}" for i in range(6))
MOVE_TOTALS = ", ".join([f"coalesce(a.s{i}, 0) + coalesce(b.s{i}, 0) - coalesce(x.s{i}, 0)" for i in range(6)] + ["coalesce(a.moves, 0) + coalesce(b.moves, 0) - coalesce(x.moves, 0)"])


@query(
    "context_fingerprint",
    "game_pk:i fingerprint:s",
    f"""p as (select distinct team, player_id, status from roster_lines where capture = 2),
    r as (select team, sha256(string_agg(sha256('{{"player_id":' || player_id || ',"status":"' || status || '"}}'), ',' order by sha256('{{"player_id":' || player_id || ',"status":"' || status || '"}}'))) as roster from p group by team),
    m as (select distinct from_team, to_team, sha256(transaction_id || '|' || coalesce(from_team, '~') || '|' || to_team || '|{{"kind":"' || kind || '","major":' || major || '}}') as d from roster_moves),
    s as (select from_team as team, d from m where from_team is not null union select to_team, d from m),
    tl as (select team, {MOVE_LANES}, count(*) as moves from s group by team),
    t as (select coalesce(r.team, tl.team) as team, roster, tl.* exclude (team) from r full join tl on r.team = tl.team),
    x as (select least(from_team, to_team) as low, greatest(from_team, to_team) as high, {MOVE_LANES}, count(*) as moves from m where from_team <> to_team group by 1, 2),
    g as (select game_pk, feed_status, least(home_team, away_team) as low, greatest(home_team, away_team) as high from schedule)
    => select game_pk, sha256(concat_ws('|', feed_status, g.low, coalesce(a.roster, '~'), g.high, coalesce(b.roster, '~'), {MOVE_TOTALS})) as fingerprint
       from g left join t a on a.team = g.low left join t b on b.team = g.high left join x on x.low = g.low and x.high = g.high""",
)
def context_fingerprint(t):
    """Games whose clubs' rosters and moves are as they were keep their digest, whenever and wherever captured."""
    player = F.struct("player_id", "status")
    rosters = t.roster_lines.groupBy("team", F.col("capture").alias("captured_at")).agg(F.min("file_path").alias("file_path"), F.collect_list(player).alias("players"))
    moves = t.roster_moves.select("transaction_id", "from_team", "to_team", F.struct("kind", "major").alias("payload"))
    games = t.schedule.select("game_pk", "home_team", "away_team", "feed_status")
    return identity.context_fingerprint(games, rosters, moves, ["feed_status"])
