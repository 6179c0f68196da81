"""Starter, bullpen, lineup and plate-appearance profile queries."""

from pyspark.sql import functions as F

from slatewise.operators import pitching, profiles
from slatewise.plans.history_queries import doubles
from slatewise.plans.registry import query

ROLES = """
st as (select game_pk, team, min(pitcher_id) as sid from appearances where is_starter = 1 group by all),
ro as (select a.*, case when a.is_starter = 1 and a.pitcher_id = st.sid then 'S' else 'R' end as role from appearances a left join st using (game_pk, team)),
tgrid as (select distinct team, game_date from appearances)
"""
FIP = "(13.0 * coalesce(sum(x.home_runs), 0) + 3.0 * (coalesce(sum(x.walks), 0) + coalesce(sum(x.hit_batters), 0)) - 2.0 * coalesce(sum(x.strikeouts), 0) + 1.1 * {ip}) / (coalesce(sum(x.outs), 0) / 3.0 + {ip}) + 3.1"
PIT = f"""
sg as (select distinct pitcher_id, game_date from ro where role = 'S'),
sx as (select g.pitcher_id as pid, g.game_date as gd, x.*, row_number() over (partition by g.pitcher_id, g.game_date order by x.game_date desc, x.game_pk desc, x.team desc) as rn
   from sg g left join (select * from ro where role = 'S') x on x.pitcher_id = g.pitcher_id and x.game_date < g.game_date),
pit as (select pid as pitcher_id, gd as game_date, {FIP.format(ip='20.0')} as starter_fip, 100.0 * (coalesce(sum(x.strikeouts), 0) - coalesce(sum(x.walks), 0) + 8.5) / (coalesce(sum(x.batters_faced), 0) + 85.0) as starter_k_minus_bb,
   avg(x.pitches) filter (where rn <= 3) as starter_recent_pitches, count(x.game_pk) as starter_starts_observed from sx x group by pid, gd)
"""
PEN = f"""
pen as (select g.team, g.game_date, {FIP.format(ip='60.0')} as bullpen_xfip,
   least(1.5, greatest(0.0, coalesce(sum(x.pitches * case date_diff('day', x.game_date, g.game_date) when 1 then 1.0 when 2 then 0.6 when 3 then 0.3 else 0.0 end), 0) / 110.0)) as bullpen_fatigue
   from tgrid g left join (select team, game_date, sum(home_runs) as home_runs, sum(walks) as walks, sum(hit_batters) as hit_batters, sum(strikeouts) as strikeouts, sum(outs) as outs, sum(pitches) as pitches from ro where role = 'R' group by all) x
   on x.team = g.team and x.game_date < g.game_date group by g.team, g.game_date)
"""
CLOSER = """
rl as (select team, pitcher_id, game_date, sum(pitches) as pitches, sum(3 * saves + games_finished) as pts from ro where role = 'R' group by all),
cum as (select *, sum(pts) over (partition by team, pitcher_id order by game_date) as score from rl),
cl as (select g.team, g.game_date, arg_max(c.pitcher_id, c.score * 1000000000 + c.pitcher_id) as closer_id from tgrid g left join cum c on c.team = g.team and c.game_date < g.game_date group by g.team, g.game_date),
cu as (select cl.team, cl.game_date, cl.closer_id, coalesce(sum(pitches) filter (where rl.game_date = cl.game_date - 1), 0) as l1, coalesce(sum(pitches), 0) as l2
   from cl left join rl on rl.team = cl.team and rl.pitcher_id = cl.closer_id and rl.game_date between cl.game_date - 2 and cl.game_date - 1 group by all),
closer as (select team, game_date, closer_id, case when l1 >= 25 or l2 >= 45 then 0.0 when l1 >= 15 or l2 >= 35 then 0.5 else 1.0 end as closer_available from cu)
"""


@query(
    "pitcher_pit_profile",
    "pitcher_id:i game_date:s starter_fip:d starter_k_minus_bb:d starter_recent_pitches:d starter_starts_observed:i",
    f"{ROLES}, {PIT} => select * from pit",
)
def pitcher_pit_profile(t):
    return pitching.pitcher_pit_profile(t.appearances)


@query("bullpen_pit_profile", "team:s game_date:s bullpen_xfip:d bullpen_fatigue:d", f"{ROLES}, {PEN} => select * from pen")
def bullpen_pit_profile(t):
    return pitching.bullpen_pit_profile(t.appearances)


@query("closer_availability", "team:s game_date:s closer_id:i closer_available:d", f"{ROLES}, {CLOSER} => select * from closer")
def closer_availability(t):
    return pitching.closer_availability(t.appearances)


DIFFS = ", ".join(f"a.{c} - b.{c} as {c}_diff" for c in pitching.CONTEXT_FIELDS)
CONTEXT_ROWS = f"""{ROLES}, {PIT}, {PEN}, {CLOSER},
sides as (select s.game_pk, s.team, p.*, pen.bullpen_xfip, pen.bullpen_fatigue, closer.closer_available from ro s join pit p on p.pitcher_id = s.pitcher_id and p.game_date = s.game_date
  join pen on pen.team = s.team and pen.game_date = s.game_date join closer on closer.team = s.team and closer.game_date = s.game_date where s.role = 'S'),
pcr as (select c.game_pk, c.game_date, c.team_a, c.team_b, {DIFFS} from contests c join sides a on a.game_pk = c.game_pk and a.team = c.team_a join sides b on b.game_pk = c.game_pk and b.team = c.team_b)"""


@query("pitching_context_rows", "game_pk:i game_date:s team_a:s team_b:s " + doubles(f"{c}_diff" for c in pitching.CONTEXT_FIELDS), f"{CONTEXT_ROWS} => select * from pcr")
def pitching_context_rows(t):
    return pitching.pitching_context_rows(t.appearances, t.contests)


COVERAGE = [f"{c}_diff" for c in pitching.CONTEXT_FIELDS]


@query(
    "dataset_audit",
    "rows:i date_min:s date_max:s duplicate_game_pks:i missing_columns:s status:s " + doubles(f"{c}_coverage" for c in COVERAGE),
    f"{CONTEXT_ROWS} => select count(*) as rows, min(game_date) as date_min, max(game_date) as date_max, count(*) - count(distinct game_pk) as duplicate_game_pks, 'umpire' as missing_columns, 'FAIL' as status, "
    + ", ".join(f"count({c}) / count(*) as {c}_coverage" for c in COVERAGE)
    + " from pcr",
)
def dataset_audit(t):
    rows = pitching.pitching_context_rows(t.appearances, t.contests)
    return pitching.dataset_audit(rows, ["game_pk", "game_date", "team_a", "team_b", "umpire", *COVERAGE], COVERAGE)


RECENT = """
tm as (select game_pk, game_date, home_team as team, feed_status <> 'P' as completed from schedule union all select game_pk, game_date, away_team, feed_status <> 'P' from schedule),
mg as (select distinct team, game_date from tm),
recent as (select g.team, g.game_date as target_date, x.game_pk, greatest(0, date_diff('day', x.game_date, g.game_date) - 1) as days_ago from mg g join tm x on x.team = g.team and x.game_date < g.game_date and x.completed
  qualify row_number() over (partition by g.team, g.game_date order by x.game_date desc, x.game_pk) <= 4)
"""


def _recent(t):
    sides = t.schedule.select("game_pk", "game_date", F.explode(F.array("home_team", "away_team")).alias("team"), (F.col("feed_status") != "P").alias("completed"))
    return pitching.recent_team_games(sides)


@query("recent_team_games", "team:s target_date:s game_pk:i days_ago:i", f"{RECENT} => select * from recent")
def recent_team_games(t):
    return _recent(t)


@query(
    "bullpen_usage",
    "team:s target_date:s games_observed:i relief_pitches:d relief_innings:d appearances:d high_leverage_pitches:i fatigue:d closer_available:d",
    f"""{RECENT}, {ROLES}, r as (select game_pk, team, sum(pitches) as p, sum(outs) as o, count(*) as n, sum(pitches) filter (where saves > 0) as lev from ro where role = 'R' group by all),
    j as (select rc.team, rc.target_date, days_ago, case days_ago when 0 then 1.0 when 1 then 0.65 when 2 then 0.35 else 0.15 end as w, p, o, n, lev from recent rc left join r on r.game_pk = rc.game_pk and r.team = rc.team),
    s as (select team, target_date, count(*) as games_observed, coalesce(sum(w * p), 0) as relief_pitches, coalesce(sum(w * o), 0) / 3.0 as relief_innings, coalesce(sum(w * n), 0) as appearances,
      case when count(lev) > 0 then coalesce(sum(lev) filter (where days_ago = 0), 0) end as high_leverage_pitches from j group by all)
    => select *, least(1.5, relief_pitches / 125.0) as fatigue, case when high_leverage_pitches >= 30 then 0.0 when high_leverage_pitches >= 20 then 0.35 when high_leverage_pitches >= 10 then 0.75 when high_leverage_pitches is not null then 1.0 end as closer_available from s""",
)
def bullpen_usage(t):
    return pitching.bullpen_usage(_recent(t), t.appearances)


@query(
    "lineup_aggregate",
    "game_pk:i side:s players:i valid_players:i plate_appearances:d coverage:d " + doubles(pitching.LINEUP_RATES),
    """h as (select player_id, cast(pa as double) as pa, case when player_id % 10 <> 0 then avg_k / 1000.0 end as ba, obp_k / 1000.0 as obp, slg_k / 1000.0 as slg, walks / pa as walk_rate, strikeouts / pa as strikeout_rate,
      case when player_id % 15 <> 0 then (0.69 * greatest(0, walks - ibb) + 0.72 * hbp + 0.88 * greatest(0, hits - doubles - triples - homers) + 1.247 * doubles + 1.578 * triples + 2.031 * homers) / nullif(ab + walks - ibb + sac_flies + hbp, 0) end as woba
      from hitter_seasons where player_id % 17 <> 0)
    => select l.game_pk, l.side, count(*) as players, count(h.pa) as valid_players, coalesce(sum(h.pa), 0) as plate_appearances, count(h.pa) / count(*) as coverage,
       sum(obp * pa) / sum(pa) as obp, sum(slg * pa) / sum(pa) as slg, sum((obp + slg) * pa) / sum(pa) as ops, sum((slg - ba) * pa) / sum(pa) filter (where ba is not null) as iso,
       sum(walk_rate * pa) / sum(pa) as walk_rate, sum(strikeout_rate * pa) / sum(pa) as strikeout_rate, sum(woba * pa) / sum(pa) filter (where woba is not null) as woba_proxy
       from lineups l left join h using (player_id) group by l.game_pk, l.side""",
)
def lineup_aggregate(t):
    return pitching.lineup_aggregate(t.lineups, t.hitter_seasons)


@query(
    "reliever_filter",
    "game_pk:i pitcher_id:i games:i starts:i",
    f"""{ROLES}, s as (select pitcher_id, games, starts from pitcher_seasons where games > 0 and (starts <= 2 or starts / games < 0.5)),
    ros as (select distinct game_pk, pitcher_id from appearances) => select ros.*, s.games, s.starts from ros join s using (pitcher_id) where not exists (select 1 from ro where ro.role = 'S' and ro.game_pk = ros.game_pk and ro.pitcher_id = ros.pitcher_id)""",
)
def reliever_filter(t):
    starters = pitching.with_roles(t.appearances).filter("role = 'S'")
    return pitching.reliever_filter(t.appearances.select("game_pk", "pitcher_id").distinct(), t.pitcher_seasons, starters)


FLAGS = ("k", "k_safe", "walk", "hbp", "single", "double", "triple", "hr", "roe", "fc", "xi", "othout", "sh", "sf")


def _raw_plays(t):
    """Flag rows from the event table, as a play-by-play feed delivers them."""
    e = t.raw("events")
    n = F.col("event_id")
    cols = {f: F.when((n * (i + 3)) % 17 < 2, 1.0) for i, f in enumerate(FLAGS)}
    base = {f"br{i}_{s}": F.when((n + i * j) % 3 == 0, F.col("user_id")) for i in (1, 2, 3) for j, s in ((1, "pre"), (5, "post"))}
    return e.select("event_id", (n % 3).cast("int").alias("outs_pre"), (n % 5).cast("int").alias("outs_post"), *[c.alias(k) for k, c in {**cols, **base}.items()])


FLAG_SQL = ", ".join(f"(event_id * {i + 3}) % 17 < 2 as f_{f}" for i, f in enumerate(FLAGS))
MASK_SQL = ", ".join("(" + " + ".join(f"case when (event_id + {i * j}) % 3 = 0 then {2 ** (i - 1)} else 0 end" for i in (1, 2, 3)) + f") as base_{s}" for j, s in ((1, "pre"), (5, "post")))


@query(
    "pa_event_classify",
    "event_id:i event:s base_pre:i base_post:i outs_added:i error:s",
    f"""f as (select event_id, {FLAG_SQL}, {MASK_SQL}, event_id % 3 as op, event_id % 5 as oq from events),
    c as (select *, case when f_k_safe or f_roe or f_fc or f_xi then 'REACH' when f_k then 'K' when f_walk then 'BB' when f_hbp then 'HBP' when f_single then '1B' when f_double then '2B' when f_triple then '3B' when f_hr then 'HR' when f_othout or f_sh or f_sf then 'OUT' end as event from f)
    => select event_id, event, base_pre, base_post, oq - op as outs_added, case when event is null then 'unmapped_event' when oq < op or oq > 3 then 'invalid_outs' end as error from c""",
)
def pa_event_classify(t):
    return profiles.pa_event_classify(_raw_plays(t))


@query("event_rate_prior", "event:s n:i probability:d", "=> select event, count(*) as n, count(*) / sum(count(*)) over () as probability from plays group by event")
def event_rate_prior(t):
    return profiles.event_rate_prior(t.plays)


TRANSITIONS = "tr as (select outs_pre, base_pre, event, outs_added, base_post, runs, count(*) as n, count(*) / sum(count(*)) over (partition by outs_pre, base_pre, event) as probability from plays group by outs_pre, base_pre, event, outs_added, base_post, runs)"
STATE = "outs_pre:i base_pre:i event:s outs_added:i base_post:i runs:i n:i probability:d"


@query("transition_distribution", STATE, f"{TRANSITIONS} => select * from tr")
def transition_distribution(t):
    return profiles.transition_distribution(t.plays)


EVENT_VALUES = ", ".join(f"('{e}')" for e in profiles.EVENTS)


@query(
    "transition_grid_fill",
    STATE + " source:s",
    f"""{TRANSITIONS}, grid as (select o.o as outs_pre, b.b as base_pre, e.e as event from range(3) o(o), range(8) b(b), (values {EVENT_VALUES}) e(e)),
    ov as (select event, outs_added, base_post, runs, count(*) as n, count(*) / sum(count(*)) over (partition by event) as probability from plays group by event, outs_added, base_post, runs)
    => select grid.*, tr.outs_added, tr.base_post, tr.runs, tr.n, tr.probability, 'exact' as source from grid join tr using (outs_pre, base_pre, event)
    union all select grid.*, ov.outs_added, ov.base_post, ov.runs, ov.n, ov.probability, 'event' from grid join ov using (event) where not exists (select 1 from tr where tr.outs_pre = grid.outs_pre and tr.base_pre = grid.base_pre and tr.event = grid.event)""",
)
def transition_grid_fill(t):
    return profiles.transition_grid_fill(t.plays)


def pr(e: str) -> str:
    return f"(select coalesce(sum(case when event = '{e}' then 1.0 else 0.0 end), 0) / count(*) from plays)"


PRIOR = "pv as (select " + ", ".join(f"{pr(e)} as p{i}" for i, e in enumerate(profiles.EVENTS)) + ")"
HITTERS = """hp as (select player_id, cast(case when player_id % 17 = 0 then 0 else pa end as double) as n, v.* from hitter_seasons, pv,
  lateral (select cast(strikeouts as double) as c0, cast(walks as double) as c1, cast(hbp as double) as c2, cast(greatest(0, hits - doubles - triples - homers) as double) as c3, cast(doubles as double) as c4, cast(triples as double) as c5, cast(homers as double) as c6) v),
hres as (select *, greatest(0.0, n - c0 - c1 - c2 - c3 - c4 - c5 - c6) as res from hp),
hprof as (select player_id, n as opportunities, """ + ", ".join(f"case when player_id % 17 = 0 then 0.0 else c{i} end as c{i}" for i in range(7)) + """,
  case when player_id % 17 = 0 or p7 + p8 = 0 then 0.0 else res * p7 / (p7 + p8) end as c7, case when player_id % 17 = 0 then 0.0 when p7 + p8 = 0 then res else res - res * p7 / (p7 + p8) end as c8 from hres, pv)"""
PITCHERS = """pp as (select pitcher_id, cast(batters_faced as double) as n, cast(strikeouts as double) as c0, cast(walks as double) as c1, cast(case when pitcher_id % 5 = 0 then 0 else hit_batters end as double) as c2,
  greatest(0.0, hits - home_runs) as hip, cast(home_runs as double) as c6, cast(hits as double) as h from pitcher_seasons),
pprof as (select pitcher_id, n as opportunities, c0, c1, c2, hip * p3 / (p3 + p4 + p5) as c3, hip * p4 / (p3 + p4 + p5) as c4, hip * p5 / (p3 + p4 + p5) as c5, c6,
  case when p7 + p8 = 0 then 0.0 else greatest(0.0, n - c0 - c1 - c2 - h) * p7 / (p7 + p8) end as c7, case when p7 + p8 = 0 then greatest(0.0, n - c0 - c1 - c2 - h) else greatest(0.0, n - c0 - c1 - c2 - h) * p8 / (p7 + p8) end as c8 from pp, pv)"""
NINE = " ".join(f"c{i}:d" for i in range(9))


def spread(df, column, prefix="c"):
    return df.select("*", *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(9)])


@query(
    "event_profile_counts",
    f"kind:s id:i opportunities:d {NINE}",
    f"{PRIOR}, {HITTERS}, {PITCHERS} => select 'hitter' as kind, player_id as id, * exclude (player_id) from hprof union all select 'pitcher', pitcher_id, * exclude (pitcher_id) from pprof",
)
def event_profile_counts(t):
    prior = profiles.event_rate_prior(t.plays)
    parts = [
        profiles.event_profile_counts(seasons, prior, kind).withColumnRenamed(key, "id").withColumn("kind", F.lit(kind))
        for seasons, kind, key in ((t.hitter_seasons, "hitter", "player_id"), (t.pitcher_seasons, "pitcher", "pitcher_id"))
    ]
    return spread(parts[0].unionByName(parts[1]), "counts")


SUM9 = ", ".join(f"coalesce(sum(c{i}), 0) as c{i}" for i in range(9))
TEAM_PROFILES = f"tp as (select a.team, sum(opportunities) as opportunities, {SUM9} from (select distinct team, pitcher_id from appearances) a join pprof using (pitcher_id) group by a.team)"


def _team_profiles(t):
    prior = profiles.event_rate_prior(t.plays)
    counts = profiles.event_profile_counts(t.pitcher_seasons, prior, "pitcher")
    return profiles.profile_combine(t.appearances.select("team", "pitcher_id").distinct().join(counts, "pitcher_id"), ["team"]), prior


@query("profile_combine", f"team:s opportunities:d {NINE}", f"{PRIOR}, {PITCHERS}, {TEAM_PROFILES} => select * from tp")
def profile_combine(t):
    return spread(_team_profiles(t)[0], "counts")


def rates_sql(source: str, key: str, k: float, name: str) -> str:
    raw = ", ".join(f"greatest(1e-12, (c{i} + {k} * p{i}) / (opportunities + {k})) as q{i}" for i in range(9))
    total = " + ".join(f"q{i}" for i in range(9))
    return f"{name} as (select {key}, " + ", ".join(f"q{i} / ({total}) as r{i}" for i in range(9)) + f" from (select {key}, {raw} from {source}, pv) z)"


@query(
    "posterior_rates",
    "team:s " + " ".join(f"r{i}:d" for i in range(9)),
    f"{PRIOR}, {PITCHERS}, {TEAM_PROFILES}, {rates_sql('tp', 'team', 240.0, 'br')} => select * from br",
)
def posterior_rates(t):
    combined, prior = _team_profiles(t)
    return spread(profiles.posterior_rates(combined, prior, profiles.BULLPEN_PRIOR), "rates", "r")


FLOORED = "pf as (select " + ", ".join(f"greatest(1e-9, p{i}) / (" + " + ".join(f"greatest(1e-9, p{j})" for j in range(9)) + f") as p{i}" for i in range(9)) + " from pv)"


def matchup_sql() -> str:
    rate = lambda src, key, k, name: rates_sql(src, key, k, name).replace(", pv)", ", pf)")
    lift = lambda x, i: f"sqrt(least(1e6, greatest(1e-6, {x}.r{i} / p{i})))"
    raw = ", ".join(
        f"greatest(1e-12, p{i} * {lift('b', i)} * {lift('p', i)}" + ("" if i in (0, 8) else " * case when side = 'home' then 1.04 else 1.0 end") + f") as m{i}" for i in range(9)
    )
    total = " + ".join(f"m{i}" for i in range(9))
    return f"""{PRIOR}, {FLOORED}, {HITTERS}, {PITCHERS}, {TEAM_PROFILES}, {rate('hprof', 'player_id', 60.0, 'hb')}, {rate('pprof', 'pitcher_id', 90.0, 'ps')}, {rate('tp', 'team', 240.0, 'pb')},
    {ROLES}, opp as (select game_pk, case when team = home_team then 'away' else 'home' end as side, team, pitcher_id from ro join contests using (game_pk) where role = 'S'),
    m as (select l.game_pk, l.side, l.player_id, 'starter' as role, {raw} from lineups l join opp using (game_pk, side) join hb b using (player_id) join ps p using (pitcher_id), pf
      union all select l.game_pk, l.side, l.player_id, 'bullpen', {raw} from lineups l join opp using (game_pk, side) join hb b using (player_id) join pb p using (team), pf)
    => select game_pk, side, player_id, role, """ + ", ".join(f"m{i} / ({total}) as c{i}" for i in range(9)) + " from m"


@query("batter_pitcher_matchup", f"game_pk:i side:s player_id:i role:s {NINE}", matchup_sql())
def batter_pitcher_matchup(t):
    combined, prior = _team_profiles(t)
    hitters = profiles.event_profile_counts(t.hitter_seasons, prior, "hitter")
    pitchers = profiles.event_profile_counts(t.pitcher_seasons, prior, "pitcher")
    home = t.contests.select("game_pk", "home_team")
    faced = pitching.with_roles(t.appearances).filter("role = 'S'").join(home, "game_pk").select(
        "game_pk", F.when(F.col("team") == F.col("home_team"), "away").otherwise("home").alias("side"), "team", "pitcher_id"
    )
    start = faced.join(pitchers, "pitcher_id").select("game_pk", "side", F.lit("starter").alias("role"), "counts", "opportunities")
    relief = faced.join(combined, "team").select("game_pk", "side", F.lit("bullpen").alias("role"), "counts", "opportunities")
    batters = t.lineups.join(hitters, "player_id").withColumn("batting_home", F.col("side") == "home")
    return spread(profiles.batter_pitcher_matchup(batters, start.unionByName(relief), prior, ["game_pk", "side"]), "probabilities")
