"""Form queries: point-in-time state per team, starter and contest."""

from slatewise.operators import history, metrics, scoring
from slatewise.plans import shared
from slatewise.plans.registry import query

GAMES = """
tg as (
  select game_pk, game_date, team_a as team, team_b as opponent, cast(a_win as double) as win, cast(a_runs as double) as rf,
         cast(b_runs as double) as ra, cast(a_runs - b_runs as double) as rd, a_starter as starter, cast(team_a_is_home as double) as was_home from contests
  union all
  select game_pk, game_date, team_b, team_a, cast(1 - a_win as double), cast(b_runs as double),
         cast(a_runs as double), cast(b_runs - a_runs as double), b_starter, cast(1 - team_a_is_home as double) from contests),
grid as (select distinct team, game_date from tg)
"""


def prior(key: str, depth: int, source: str = "tg", name: str = "past", grid: str = "grid") -> str:
    """Games strictly before each (key, date), newest first, by brute force."""
    return f"""{name} as (
      select g.{key}, g.game_date, x.* exclude ({key}, game_date), x.game_date as past_date,
             row_number() over (partition by g.{key}, g.game_date order by x.game_date desc, x.game_pk desc) as rn
      from {grid} g join {source} x on x.{key} = g.{key} and x.game_date < g.game_date
      qualify rn <= {depth})"""


def rolling_select(metrics_defaults: dict[str, float], lengths, prefix: str = "", key: str = "team", past: str = "past", grid: str = "grid") -> str:
    cols = ", ".join(
        f"coalesce(avg(p.{m}) filter (where rn <= {n}), {d}) as {prefix}{m}{n}" for m, d in metrics_defaults.items() for n in lengths
    )
    return f"select g.{key}, g.game_date, {cols} from {grid} g left join {past} p on p.{key} = g.{key} and p.game_date = g.game_date group by g.{key}, g.game_date"


def momentum_select(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{m}3 - {prefix}{m}10 as {prefix}form_{m}_momentum" for m in history.FORM_DEFAULTS)


STRENGTH = """
strength as (
  select *, rf_pg - ra_pg as run_diff_pg, pow(rf_pg, 1.83) / (pow(rf_pg, 1.83) + pow(ra_pg, 1.83)) as pyth from (
    select g.team, g.game_date, cast(count(x.team) as double) as games,
           (coalesce(sum(x.win), 0) + 5.0) / (count(x.team) + 10.0) as win_pct,
           (coalesce(sum(x.rf), 0) + 43.5) / (count(x.team) + 10.0) as rf_pg,
           (coalesce(sum(x.ra), 0) + 43.5) / (count(x.team) + 10.0) as ra_pg
    from grid g left join tg x on x.team = g.team and x.game_date < g.game_date group by g.team, g.game_date) s)
"""
ROLLING = prior("team", 20) + f", rolling as (select *, {momentum_select()} from ({rolling_select(history.FORM_DEFAULTS, history.FORM_WINDOWS)}) r)"


def ewm(alpha: float, name: str = "ewm", grid: str = "grid") -> str:
    keep = 1 - alpha
    terms = ", ".join(
        f"coalesce(sum(x.{m} * {alpha} * pow({keep}, rn - 1)) filter (where rn <= 400), 0) + {p} * pow({keep}, count(x.team)) as ewm_{m}"
        for m, p in (("rf", 4.35), ("ra", 4.35), ("win", 0.5))
    )
    return f"""{name} as (
      select team, game_date, {terms} from (
        select g.team as team, g.game_date as game_date, x.rf, x.ra, x.win, x.game_pk,
               row_number() over (partition by g.team, g.game_date order by x.game_date desc, x.game_pk desc) as rn
        from {grid} g left join tg x on x.team = g.team and x.game_date < g.game_date) x
      group by team, game_date)""".replace("count(x.team)", "count(x.game_pk)")


LAST = """
last_game as (
  select g.team, g.game_date, case when p.team is null then 0.0 else 1.0 end as last_game_known,
         coalesce(p.win, 0.5) as last_win, coalesce(p.rf, 4.35) as last_rf, coalesce(p.ra, 4.35) as last_ra, coalesce(p.rd, 0.0) as last_rd,
         coalesce(p.rf + p.ra, 8.7) as last_total_runs, coalesce(abs(p.rd), 0.0) as last_abs_margin, coalesce(p.was_home, 0.5) as last_was_home,
         coalesce(s.win_pct, 0.5) as last_opponent_win_pct, coalesce(s.pyth, 0.5) as last_opponent_pyth,
         case when p.ra = 0 then 1.0 else 0.0 end as last_scored_shutout, case when p.rf = 0 then 1.0 else 0.0 end as last_was_shutout,
         case when p.rd >= 6 then 1.0 else 0.0 end as last_blowout_win, case when p.rd <= -6 then 1.0 else 0.0 end as last_blowout_loss
  from grid g left join past p on p.team = g.team and p.game_date = g.game_date and p.rn = 1
  left join strength s on s.team = p.opponent and s.game_date = p.past_date)
"""
REST = """
rest as (
  select g.team, g.game_date,
         coalesce(max(case when rn = 1 then least(7, date_diff('day', past_date, g.game_date)) end), 3) as rest_days,
         count(*) filter (where rn <= 10 and date_diff('day', past_date, g.game_date) <= 3) as games_last3,
         count(*) filter (where rn <= 10 and date_diff('day', past_date, g.game_date) <= 7) as games_last7
  from grid g left join past p on p.team = g.team and p.game_date = g.game_date group by g.team, g.game_date)
"""
STARTER = (
    "sgrid as (select distinct starter, game_date from tg), "
    + prior("starter", 100000000, name="spast", grid="sgrid")
    + """, starter_state as (
  select g.starter, g.game_date, cast(count(p.rn) as double) as starter_starts,
         (coalesce(sum(p.win), 0) + 2.0) / (count(p.rn) + 4.0) as starter_team_win_pct,
         (coalesce(sum(p.ra), 0) + 17.4) / (count(p.rn) + 4.0) as starter_team_ra,
         coalesce(avg(p.ra) filter (where rn <= 5), 4.35) as starter_recent_ra,
         coalesce(avg(p.win) filter (where rn <= 5), 0.5) as starter_recent_win
  from sgrid g left join spast p on p.starter = g.starter and p.game_date = g.game_date group by g.starter, g.game_date)
"""
)
ADJUSTED = (
    """
adj as (
  select team, game_date, game_pk, win, rf, ra, greatest(-12.0, least(12.0, rf + ra)) as rd from (
    select t.team, t.game_date, t.game_pk, t.win - (1 - greatest(0.0, least(1.0, 0.5 * (s.win_pct + s.pyth)))) as win,
           greatest(-8.0, least(8.0, t.rf - s.ra_pg)) as rf, greatest(-8.0, least(8.0, s.rf_pg - t.ra)) as ra
    from tg t join strength s on s.team = t.opponent and s.game_date = t.game_date) r), """
    + prior("team", 20, "adj", "apast")
    + f", adjusted as (select *, {momentum_select('opp_adj_')} from ({rolling_select(dict.fromkeys(history.FORM_DEFAULTS, 0.0), history.FORM_WINDOWS, 'opp_adj_', past='apast')}) r)"
)
SNAPSHOT = ", ".join([GAMES, STRENGTH, ROLLING, ewm(0.25), LAST, REST, STARTER])
TEAM_TABLES = ("strength", "rolling", "ewm", "rest", "last_game")


def features_sql(columns: tuple[str, ...] = history.snapshot_columns(), team_tables=TEAM_TABLES) -> str:
    """CTEs ending in ``features``: one row per contest with every diff and sum."""
    team = "snap as (select * from grid " + " ".join(f"join {t} using (team, game_date)" for t in team_tables) + ")"
    diffs = ", ".join(f"a.{c} - b.{c} as {c}_diff" for c in columns)
    sums = ", ".join(f"a.{c} + b.{c} as {c}_sum" for c in columns if c in history.SUMMED_FEATURES)
    starters = ", ".join(f"sa.{c} - sb.{c} as {c}_diff" for c in history.STARTER)
    return f"""{SNAPSHOT}, {team}, features as (
      select c.game_pk, c.game_date, c.team_a, c.team_b, c.a_runs, c.b_runs, c.a_win, c.team_a_is_home, {diffs}, {sums}, {starters}
      from contests c
      join snap a on a.team = c.team_a and a.game_date = c.game_date join snap b on b.team = c.team_b and b.game_date = c.game_date
      join starter_state sa on sa.starter = c.a_starter and sa.game_date = c.game_date
      join starter_state sb on sb.starter = c.b_starter and sb.game_date = c.game_date)"""


def logit_sql(weights: dict[str, float]) -> str:
    z = " + ".join(f"{w} * {c}" for c, w in weights.items())
    return f"1.0 / (1.0 + exp(-greatest(-8.0, least(8.0, {z}))))"


SCORED = (
    features_sql()
    + f", scored as (select *, {logit_sql(scoring.PRIOR_WEIGHTS)} as prior_probability, {logit_sql(scoring.STRENGTH_WEIGHTS)} as strength_probability from features)"
)
ONLY_KEY = "team:s game_date:s "


def doubles(columns) -> str:
    return " ".join(f"{c}:d" for c in columns)


def feature_names(columns=history.snapshot_columns()) -> list[str]:
    return (
        [f"{c}_diff" for c in columns]
        + [f"{c}_sum" for c in columns if c in history.SUMMED_FEATURES]
        + [f"{c}_diff" for c in history.STARTER]
    )


@query("season_strength", ONLY_KEY + doubles(history.STRENGTH), f"{GAMES}, {STRENGTH} => select * from strength")
def season_strength(t):
    return history.season_strength(history.team_games(t.contests))


@query("rolling_form", ONLY_KEY + doubles(history.ROLLING), f"{GAMES}, {ROLLING} => select * from rolling")
def rolling_form(t):
    return history.rolling_form(history.team_games(t.contests))


@query("form_momentum", ONLY_KEY + doubles(history.MOMENTUM), f"{GAMES}, {ROLLING} => select * from rolling")
def form_momentum(t):
    return history.form_momentum(history.team_games(t.contests))


@query(
    "ewm_form",
    ONLY_KEY + doubles(history.EWM) + " " + doubles(f"base_{c}" for c in history.EWM),
    f"{GAMES}, {ewm(0.25)}, {ewm(0.18, 'slow')} => select ewm.*, slow.ewm_rf as base_ewm_rf, slow.ewm_ra as base_ewm_ra, slow.ewm_win as base_ewm_win from ewm join slow using (team, game_date)",
)
def ewm_form(t):
    games = history.team_games(t.contests)
    slow = history.ewm_form(games, alpha=history.EWM_BASELINE_ALPHA).withColumnsRenamed({c: f"base_{c}" for c in history.EWM})
    return history.ewm_form(games).join(slow, history.KEY)


@query("last_game_context", ONLY_KEY + doubles(history.LAST_GAME_DEFAULTS), f"{GAMES}, {STRENGTH}, {prior('team', 20)}, {LAST} => select * from last_game")
def last_game_context(t):
    return history.last_game_context(history.team_games(t.contests))


@query("rest_density", ONLY_KEY + doubles(history.REST), f"{GAMES}, {prior('team', 20)}, {REST} => select * from rest")
def rest_density(t):
    return history.rest_density(history.team_games(t.contests))


@query("starter_form", "starter:s game_date:s " + doubles(history.STARTER), f"{GAMES}, {STARTER} => select * from starter_state")
def starter_form(t):
    return history.starter_form(history.team_games(t.contests))


@query("opponent_adjusted_form", ONLY_KEY + doubles(history.ADJUSTED), f"{GAMES}, {STRENGTH}, {ADJUSTED} => select * from adjusted")
def opponent_adjusted_form(t):
    return history.opponent_adjusted_form(history.team_games(t.contests))


@query("matchup_features", "game_pk:i game_date:s team_a:s team_b:s a_win:i team_a_is_home:i " + doubles(feature_names()), f"{features_sql()} => select * from features")
def matchup_features(t):
    return shared.matchups(t)


FUTURE = (
    GAMES
    + """, targets as (select game_pk, game_date + 3653 as game_date, team_a, team_b, a_starter, b_starter from contests),
fgrid as (select distinct team, t.game_date from (select team_a as team, game_date from targets union select team_b, game_date from targets) t),
latest as (select *, row_number() over (partition by team order by game_date desc, game_pk desc) as rn from tg),
ends as (
  select team, count(*) as games, (sum(win) + 5.0) / (count(*) + 10.0) as win_pct, (sum(rf) + 43.5) / (count(*) + 10.0) as rf_pg,
         (sum(ra) + 43.5) / (count(*) + 10.0) as ra_pg, avg(rd) filter (where rn <= 10) as rd10, max(rf) filter (where rn = 1) as last_rf,
         sum(rf * 0.25 * pow(0.75, rn - 1)) + 4.35 * pow(0.75, count(*)) as ewm_rf, max(game_date) as last_date from latest group by team)
"""
)


@query(
    "pregame_state_asof",
    "game_pk:i game_date:s team_a:s team_b:s games_diff:d win_pct_diff:d rf_pg_sum:d ra_pg_sum:d rd10_diff:d last_rf_sum:d ewm_rf_sum:d rest_days_diff:d",
    FUTURE
    + """=> select game_pk, t.game_date, team_a, team_b, a.games - b.games as games_diff, a.win_pct - b.win_pct as win_pct_diff, a.rf_pg + b.rf_pg as rf_pg_sum,
      a.ra_pg + b.ra_pg as ra_pg_sum, a.rd10 - b.rd10 as rd10_diff, a.last_rf + b.last_rf as last_rf_sum, a.ewm_rf + b.ewm_rf as ewm_rf_sum,
      least(7, date_diff('day', a.last_date, t.game_date)) - least(7, date_diff('day', b.last_date, t.game_date)) as rest_days_diff
      from targets t join ends a on a.team = t.team_a join ends b on b.team = t.team_b""",
)
def pregame_state_asof(t):
    from pyspark.sql import functions as F

    targets = t.contests.select("game_pk", F.date_add("game_date", 3653).alias("game_date"), "away_team", "home_team", "away_starter", "home_starter")
    return history.future_features(t.contests, targets)


@query(
    "logit_scores",
    "game_pk:i game_date:s team_a:s team_b:s prior_probability:d strength_probability:d",
    f"{SCORED} => select * from scored",
)
def logit_scores(t):
    return scoring.logit_scores(shared.matchups(t))


@query(
    "strength_calibration",
    "bin:i lower:d upper:d n:i mean_probability:d observed_rate:d absolute_gap:d",
    SCORED
    + """, binned as (select a_win as y, greatest(1e-6, least(1 - 1e-6, strength_probability)) as p from scored)
    => select 1 + len(list_filter(range(1, 10), lambda i: p >= i * cast(0.1 as double))) as bin, (bin - 1) / 10.0 as lower, bin / 10.0 as upper,
       count(*) as n, avg(p) as mean_probability, avg(y) as observed_rate, abs(avg(p) - avg(y)) as absolute_gap from binned group by bin""",
)
def strength_calibration(t):
    scored = scoring.logit_scores(shared.matchups(t))
    return metrics.calibration_table(scored, "a_win", "strength_probability")
