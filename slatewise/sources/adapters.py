"""Domain views over the generic test tables.

The given tables hold orders, customers and suppliers, not contests and quotes.  Each view
below reads them whole and is written in SQL that Spark and DuckDB evaluate identically, so
the same text feeds the Spark operators and the SQL checks.  ``$TS`` is the zone-less
timestamp type, ``$SHA[...]SHA$`` a SHA-256 digest and ``$EACH(n)`` repeats every row n times with ``draw_id`` 0..n-1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slatewise.session import work_path

# fields a pregame context carries for both sides
PAIRED_FIELDS = (
    "starter_fip", "starter_k_minus_bb", "starter_xera", "starter_xfip", "starter_siera", "starter_whip",
    "lineup_obp", "lineup_slg", "lineup_ops", "lineup_woba_proxy", "lineup_iso", "lineup_bb_rate", "lineup_k_rate", "lineup_stats_coverage",
    "injury_war", "bullpen_xfip", "bullpen_siera", "bullpen_era_proxy", "bullpen_whip_proxy", "bullpen_recent_pitches", "bullpen_recent_innings",
    "bullpen_fatigue", "bullpen_high_leverage_pitches", "closer_available", "travel_fatigue", "time_zones_crossed",
    "defense_frv", "defense_oaa", "defense_fielding_pct", "defense_errors_per_game", "catcher_framing", "baserunning_runs",
)
GAME_FIELDS = (
    "umpire_run_factor", "umpire_k_factor", "park_run_factor", "park_hr_factor", "weather_run_factor",
    "air_density", "wind_out_component", "rain_risk", "reverse_line_move",
)


def _context_columns() -> str:
    value = lambda i, scale, name: f"case when (game_pk + {i}) % {5 + i % 4} = 0 then null else cast((game_pk * {101 + 2 * i}) % {scale} as double) / cast(1000 as double) end as {name}"
    columns = []
    for i, name in enumerate(PAIRED_FIELDS):
        scale = 80000 if "pitches" in name else 2000
        columns += [value(2 * i, scale, f"away_{name}"), value(2 * i + 1, scale, f"home_{name}")]
    columns += [value(90 + i, 2000, name) for i, name in enumerate(GAME_FIELDS)]
    return ", ".join(columns)


RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    # one row per finished head-to-head contest
    "contests": """
        select game_pk, game_date, home_team, away_team, home_runs, away_runs,
               least(home_team, away_team) as team_a, greatest(home_team, away_team) as team_b,
               case when home_team < away_team then home_runs else away_runs end as a_runs,
               case when home_team < away_team then away_runs else home_runs end as b_runs,
               case when (home_team < away_team) = (home_runs > away_runs) then 1 else 0 end as a_win,
               case when home_team < away_team then home_starter else away_starter end as a_starter,
               case when home_team < away_team then away_starter else home_starter end as b_starter,
               home_starter, away_starter,
               case when home_team < away_team then 1 else 0 end as team_a_is_home,
               case when home_runs > away_runs then 1 else 0 end as home_won,
               feed_status, priority
        from (
            select o_orderkey as game_pk, cast(o_orderdate as date) as game_date,
                   'T' || lpad(cast(c_nationkey as string), 2, '0') as home_team,
                   'T' || lpad(cast(s_nationkey as string), 2, '0') as away_team,
                   cast(q1 % 13 + case when q1 % 13 = q0 % 13 then 1 else 0 end as int) as home_runs,
                   cast(q0 % 13 as int) as away_runs,
                   'C' || cast(o_custkey as string) as home_starter,
                   'S' || cast(s_key as string) as away_starter,
                   o_orderstatus as feed_status, o_orderpriority as priority
            from {orders}
            join {customer} on c_custkey = o_custkey
            join (select l_orderkey, min(l_suppkey) as s_key,
                         sum(case when l_linenumber % 2 = 1 then cast(l_quantity as int) else 0 end) as q1,
                         sum(case when l_linenumber % 2 = 0 then cast(l_quantity as int) else 0 end) as q0
                  from {lineitem} group by l_orderkey) li on l_orderkey = o_orderkey
            join {supplier} on s_suppkey = s_key
            where c_nationkey <> s_nationkey) sides
    """,
    # one row per team and contest, with neither contest id nor home/away
    "team_logs": """
        select game_date as log_date, home_team as team, away_team as opponent, home_runs as teamruns,
               home_starter as teamstarter, home_runs - away_runs as rundifferential, game_pk as log_order
        from contests
        union all
        select game_date, away_team, home_team, away_runs, away_starter, away_runs - home_runs, game_pk
        from contests
    """,
    "schedule": """
        select game_pk, game_date, away_team, home_team, away_starter, home_starter, away_runs, home_runs, feed_status, priority,
               case when feed_status = 'O' and priority = '4-NOT SPECIFIED' then null
                    else cast(game_date as $TS) + interval '1' hour * cast(12 + game_pk % 11 as int) end as start_ts,
               case feed_status when 'F' then 'Final' when 'P' then 'Final' else case when priority = '1-URGENT' then 'Live' else 'Preview' end end as status_abstract,
               case feed_status
                 when 'P' then case priority when '1-URGENT' then 'Suspended: Rain' when '2-HIGH' then 'Cancelled' else 'Postponed' end
                 when 'O' then case priority when '1-URGENT' then 'In Progress' when '2-HIGH' then 'Pre-Game' else 'Scheduled' end
                 else case priority when '1-URGENT' then 'Game Over' when '2-HIGH' then 'Completed Early' when '3-MEDIUM' then 'Final: Rescheduled' else 'Final' end end as status_detailed,
               case feed_status when 'F' then 'F' when 'P' then 'D' else 'S' end as status_code
        from contests
    """,
    # the feed repeats postponed contests with a later, partly filled record
    "schedule_feed": """
        select game_pk * 2 as arrival, game_pk, game_date, away_team, home_team, status_abstract, status_detailed,
               case when priority = '2-HIGH' then null else away_starter end as away_pitcher, case when priority <> '5-LOW' then home_starter end as home_pitcher,
               case when feed_status <> 'P' then 'Park ' || home_team end as venue_name
        from schedule
        union all
        select game_pk * 2 + 1, game_pk, cast(game_date + interval '1' day * 3 as date), away_team, case when priority = '4-NOT SPECIFIED' then 'T99' else home_team end, 'Preview',
               case when priority = '5-LOW' then 'Final' else 'Scheduled' end, case when priority = '2-HIGH' then away_starter end, null, 'Park ' || home_team
        from schedule where feed_status = 'P'
    """,
    "predictions": """
        select game_pk, game_date, team_a, team_b, a_win, team_a_is_home,
               cast((game_pk * 7919) % 900 + 50 as double) / cast(1000 as double) as baseline_probability,
               cast(((game_pk * 7919) % 900 + 50) * 6 + case when a_win = 1 then 2600 else 1400 end as double)
                   / cast(10000 as double) as candidate_probability
        from contests
    """,
    # seven model votes per contest, as long rows
    "components": """
        select game_pk, game_date, a_win, away_team, home_team,
               case draw_id when 0 then 'logistic' when 1 then 'random_forest' when 2 then 'neural_network'
                    when 3 then 'xgboost' when 4 then 'lightgbm' when 5 then 'catboost' else 'elo_pyth' end as component,
               cast((game_pk * (7919 + 104 * draw_id)) % 900 + 50 as double) / cast(1000 as double) as p
        from contests $EACH(7)
    """,
    # append-only quote history; the same quote key recurs over time
    "quotes": """
        select distinct l_orderkey as game_pk, 'B' || cast(l_suppkey % 5 as string) as sportsbook,
               case l_partkey % 4 when 0 then 'moneyline' when 1 then 'run_line'
                    when 2 then 'game_total' else 'team_total' end as market_type,
               case when l_partkey % 4 <= 1 then case when l_linenumber % 2 = 1 then home_team else away_team end
                    else case when l_linenumber % 2 = 1 then 'OVER' else 'UNDER' end end as selection,
               case when l_partkey % 4 = 3 then home_team end as team,
               case l_partkey % 4 when 1 then cast(1.5 as double)
                    when 2 then cast(8 as double) + cast(cast(l_quantity as int) % 4 as double) / cast(2 as double)
                    when 3 then cast(4 as double) end as line,
               cast(case when (l_partkey + l_suppkey) % 2 = 0 then 100 + l_partkey % 150
                         else -(100 + l_partkey % 150) end as int) as american_odds,
               cast(l_shipdate as $TS) as captured_at, game_date as event_date, home_team, away_team
        from {lineitem} join contests on game_pk = l_orderkey
    """,
    # typed quote rows as a feed delivers them, valid and broken
    "raw_quotes": """
        select l_orderkey * 10 + l_linenumber as row_id, l_orderkey - 2 as game_pk,
               case when l_linenumber = 7 then '  ' else ' B' || cast(l_suppkey % 5 as string) || ' ' end as sportsbook,
               case l_partkey % 5 when 0 then 'Moneyline' when 1 then 'run_line' when 2 then 'game_total' when 3 then 'team_total' else 'futures' end as market_type,
               case when l_returnflag = 'A' then 'over' when l_returnflag = 'N' then ' under ' else 't' || cast(l_suppkey % 25 as string) end as selection,
               case when l_linestatus = 'F' then 't' || cast(l_suppkey % 25 as string) end as team,
               case when l_partkey % 5 = 0 and l_linenumber > 2 then null when l_linenumber = 6 then null
                    else cast(l_linenumber as double) + cast(0.5 as double) end as line,
               cast(l_partkey % 300 - 150 as int) as american_odds,
               cast(cast(l_shipdate as date) as string) || case when l_linenumber = 5 then 'T18:00:00' else 'T18:00:00Z' end as captured_at
        from {lineitem}
    """,
    # typed two-way price rows, with flags, formats, blanks and duplicates
    "entries": """
        select o_orderkey as row_id,
               case o_orderpriority when '1-URGENT' then 'yes' when '2-HIGH' then '' when '3-MEDIUM' then 'TRUE' when '4-NOT SPECIFIED' then 'on' else case when o_orderstatus = 'P' then 'skip' else case when o_orderkey % 2 = 0 then 'maybe' else '1' end end end as include,
               case when o_custkey % 50 = 3 then '' when o_custkey % 50 = 4 then 'soon' else cast(cast(o_orderdate as date) as string) end as game_date,
               case when o_orderkey % 3 = 0 then cast(o_custkey as string) when o_orderkey % 3 = 1 then '' else case when o_custkey % 40 = 7 then '12.5' when o_custkey % 40 = 8 then '-4' else cast(o_orderkey as string) || '.0' end end as game_pk,
               't' || cast(o_custkey % 25 as string) as away_team, case when o_custkey % 60 = 9 then ' ' else 't' || cast((o_custkey + 7) % 25 as string) end as home_team,
               case when o_orderkey % 11 = 0 then '' when o_orderkey % 11 = 1 then 'even' when o_orderkey % 11 = 2 then '2,25' when o_orderkey % 11 = 3 then '+1,250' when o_orderkey % 11 = 4 then '99' else cast(100 + o_custkey % 200 as string) end as away_odds,
               case when o_orderkey % 13 = 0 then '' when o_orderkey % 13 = 1 then '-145' when o_orderkey % 13 = 2 then '1.5' when o_orderkey % 13 = 3 then 'n/a' else '-' || cast(101 + o_custkey % 150 as string) end as home_odds,
               case when o_orderkey % 11 = 2 then 'decimal' when o_orderstatus = 'F' then ' US ' else 'american' end as odds_format
        from {orders}
    """,
    # 125 score draws for every contest
    "draws": """
        select game_pk, home_team, away_team, cast(draw_id as int) as draw_id,
               cast((game_pk * 31 + draw_id * 17 + 3) % 11 as int) as away_runs,
               cast((game_pk * 13 + draw_id * (draw_id + 29)) % 12 as int) as home_runs
        from contests $EACH(125)
    """,
    # append-only prediction ledger; urgent contests carry a revised prediction
    "ledger": """
        select game_pk * 4 + k as sequence, k as revision, game_pk, event_type, feed_status, priority,
               cast(game_date as $TS) + interval '1' hour * hours as recorded_at,
               cast(game_date as $TS) + interval '1' hour * 18 as scheduled_start,
               game_date, away_team, home_team,
               case when event_type = 'prediction' then cast(((game_pk + k) * 7919) % 900 + 50 as double) / cast(1000 as double) end as home_probability,
               case when event_type = 'prediction' then cast(((game_pk + k) * 104729) % 900 + 50 as double) / cast(1000 as double) end as production_home_probability,
               case when event_type = 'prediction' then cast(case when game_pk % 2 = 0 then 100 + game_pk % 80 else -(100 + game_pk % 90) end as int) end as home_odds,
               case when event_type = 'prediction' then cast(case when game_pk % 2 = 1 then 100 + game_pk % 70 else -(100 + game_pk % 60) end as int) end as away_odds,
               case when event_type = 'prediction' then cast((game_pk * 5003) % 900 + 50 as double) / cast(1000 as double) end as offered_home_implied,
               case when event_type = 'prediction' then case when priority = '5-LOW' then null else 'v' || substr(priority, 1, 1) end end as model_version,
               case when event_type = 'prediction' and feed_status <> 'P' then 'c-' || feed_status end as candidate_commit,
               case when event_type = 'prediction' and priority = '2-HIGH' then 'overlay-1' end as adaptive_overlay_sha256,
               case when event_type = 'closing_line' then cast((game_pk * 6101) % 900 + 50 as double) / cast(1000 as double) end as closing_home_implied,
               case when event_type = 'outcome' then home_won end as home_won,
               case when event_type = 'prediction' then case game_pk % 4 when 0 then 'PASS' when 1 then 'ELIGIBLE' when 2 then 'ELIGIBLE' else 'BLOCKED' end end as selection_status,
               case when event_type = 'prediction' then case game_pk % 4 when 0 then case when game_pk % 3 = 0 then 'LOW_OVERLAP' else 'LOW_PROBABILITY;LOW_OVERLAP' end else '' end end as selection_reasons
        from (
            select *, 0 as k, 'prediction' as event_type, 10 as hours from contests
            union all
            select *, 1 as k, 'prediction' as event_type, 11 as hours from contests where priority = '1-URGENT'
            union all
            select *, 2 as k, 'closing_line' as event_type, 17 as hours from contests where feed_status <> 'P'
            union all
            select *, 3 as k, 'outcome' as event_type, 22 as hours from contests where feed_status <> 'O') e
    """,
    # ledger events with JSON payloads and per-contest hash chains, some of them broken
    "evidence": """
        select stream, schema_version, game_pk, event_type, recorded_at, scheduled_start, source, snapshot_sha256, provenance, payload,
               case when feed_status = 'P' and priority = '4-NOT SPECIFIED' and n > 1 then n + 1 when feed_status = 'F' and priority = '1-URGENT' and n > 2 then n - 1 else n end as sequence,
               case when feed_status = 'O' and priority = '3-MEDIUM' and n > 1 then repeat('0', 64) when n > 1 then h1 end as previous_event_sha256,
               case when feed_status = 'F' and priority = '5-LOW' and n = 2 then repeat('f', 64)
                    else $SHA[c0 || '|' || h1]SHA$ end as event_sha256
        from (
          select *, case when l1 is null then '' else $SHA[l1 || '|' || h2]SHA$ end as h1 from (
            select *, case when l2 is null then '' else $SHA[l2 || '|' || h3]SHA$ end as h2 from (
              select *, case when l3 is null then '' else $SHA[l3 || '|']SHA$ end as h3 from (
                select *, lag(c0, 1) over (partition by stream order by n) as l1, lag(c0, 2) over (partition by stream order by n) as l2,
                       lag(c0, 3) over (partition by stream order by n) as l3
                from (
                  select *, cast(schema_version as string) || '|' || cast(case when feed_status = 'F' and priority = '1-URGENT' and n > 2 then n - 1 else n end as string) || '|' || event_type || '|' || cast(game_pk as string) || '|' || cast(recorded_at as string) || '|' || cast(scheduled_start as string) || '|' || source || '|' || coalesce(snapshot_sha256, '~') || '|' || provenance || '|' || payload as c0 from (
                    select game_pk as stream, case when feed_status = 'O' and priority = '2-HIGH' and event_type = 'outcome' then 2 else 1 end as schema_version, game_pk, event_type, feed_status, priority, scheduled_start, recorded_at, 'feed-' || lower(feed_status) as source,
                           row_number() over (partition by game_pk order by sequence) as n,
                           case when event_type <> 'prediction' then null when priority = '3-MEDIUM' then 'abc' else md5(cast(game_pk as string)) || md5(cast(sequence as string)) end as snapshot_sha256,
                           case when event_type <> 'prediction' then '{}' else '{"schedule":"official","live_feed":"' || case when priority = '2-HIGH' then 'Neutral_Placeholder' else 'feed' end || '","pitcher_stats":"season"' ||
                                case when priority = '4-NOT SPECIFIED' then '' else ',"market_input":"manual"' end || '}' end as provenance,
                           case event_type
                             when 'prediction' then '{"away_team":"' || away_team || '","home_team":"' || case when revision = 1 and feed_status = 'O' then 'T99' else home_team end || '","home_probability":0.' || lpad(cast((game_pk * 7919) % 900 + 50 as string), 3, '0') ||
                               ',"away_probability":0.' || lpad(cast(case when feed_status = 'P' then 500 else 950 - (game_pk * 7919) % 900 end as string), 3, '0') ||
                               case when priority = '5-LOW' then '' else ',"model_version":"v' || substr(priority, 1, 1) || '"' end ||
                               case when priority = '2-HIGH' and feed_status = 'F' then ',"context":{"Final_Score":7}' else ',"context":{"note":1}' end ||
                               case feed_status when 'P' then ',"away_starter_id":' || cast(game_pk as string) when 'F' then ',"away_starter_id":' || cast(game_pk + 1 as string) || ',"away_starter_snapshot_sha256":"' || md5(home_team) || md5(away_team) || '","home_starter_snapshot_sha256":"' || md5(away_team) || md5(home_team) || '"' else '' end || '}'
                             when 'closing_line' then '{"closing_home_implied":' || case when feed_status = 'F' and priority = '1-URGENT' then '1.250' else '0.' || lpad(cast((game_pk * 6101) % 900 + 50 as string), 3, '0') end || '}'
                             else '{"home_won":' || case when priority = '5-LOW' and feed_status = 'P' then '2' else cast(home_won as string) end || '}' end as payload
                    from ledger) a) b) c) d) e) f
    """,
    "plays": """
        select event_id, user_id, cast(event_id % 3 as int) as outs_pre, cast(user_id % 8 as int) as base_pre,
               case event_type when 'view' then 'OUT' when 'click' then '1B' when 'error' then 'K'
                    when 'signup' then 'BB' else 'HR' end as event,
               cast(least((event_id * 7) % 3, 3 - event_id % 3) as int) as outs_added,
               cast((event_id * 5 + user_id) % 8 as int) as base_post, cast((event_id * 11) % 4 as int) as runs
        from {events}
    """,
    # one row per pitcher, contest and side
    "appearances": """
        select l_orderkey as game_pk, game_date,
               case when l_linenumber % 2 = 1 then home_team else away_team end as team,
               l_suppkey as pitcher_id, case when l_linenumber <= 2 then 1 else 0 end as is_starter,
               cast(sum(cast(l_quantity as int)) as bigint) as outs,
               cast(sum(cast(l_quantity as int) * 2 + l_partkey % 7) as bigint) as pitches,
               cast(sum(l_partkey % 9) as bigint) as strikeouts, cast(sum(l_partkey % 4) as bigint) as walks,
               cast(sum(l_partkey % 3) as bigint) as hit_batters, cast(sum(l_partkey % 2) as bigint) as home_runs,
               cast(sum(cast(l_quantity as int) + l_partkey % 9) as bigint) as batters_faced,
               max(case when l_returnflag = 'A' then 1 else 0 end) as saves,
               max(case when l_returnflag <> 'N' then 1 else 0 end) as games_finished
        from {lineitem} join contests on game_pk = l_orderkey
        group by l_orderkey, game_date, case when l_linenumber % 2 = 1 then home_team else away_team end,
                 l_suppkey, case when l_linenumber <= 2 then 1 else 0 end
    """,
    # season lines as a statistics service returns them, with the plain numbers beside the JSON
    "hitter_seasons": """
        select *, case when player_id % 17 = 0 then '{}' else
               '{"stats":[{"splits":[]},{"splits":[{"stat":{"plateAppearances":' || cast(pa as string) || ',"atBats":' || cast(ab as string) || ',"hits":' || cast(hits as string)
               || ',"doubles":' || cast(doubles as string) || ',"triples":' || cast(triples as string) || ',"homeRuns":' || cast(homers as string) || ',"baseOnBalls":' || cast(walks as string)
               || ',"intentionalWalks":' || cast(ibb as string) || ',"strikeOuts":' || cast(strikeouts as string) || ',"hitByPitch":' || cast(hbp as string)
               || case when player_id % 15 = 0 then '' else ',"sacFlies":' || cast(sac_flies as string) end
               || ',"avg":"' || case when player_id % 10 = 0 then '-.--' else '.' || lpad(cast(avg_k as string), 3, '0') end || '","obp":".' || lpad(cast(obp_k as string), 3, '0') || '","slg":".' || lpad(cast(slg_k as string), 3, '0') || '"}}]}]}' end as payload
        from (
          select player_id, pa, hits, doubles, triples, homers, walks, ibb, strikeouts, hbp, sac_flies, pa - walks - hbp - sac_flies as ab,
                 (hits * 7) % 400 as avg_k, (hits * 11) % 500 as obp_k, (hits * 13) % 700 as slg_k
          from (select l_partkey as player_id, cast(sum(cast(l_quantity as int) + 6) as bigint) as pa, cast(sum(l_linenumber) as bigint) as hits,
                       cast(sum(case when l_linenumber = 2 then 1 else 0 end) as bigint) as doubles, cast(sum(case when l_linenumber = 3 then 1 else 0 end) as bigint) as triples,
                       cast(sum(case when l_linenumber = 4 then 1 else 0 end) as bigint) as homers, cast(sum(l_suppkey % 3) as bigint) as walks,
                       cast(sum(case when l_linenumber = 7 then 1 else 0 end) as bigint) as ibb, cast(sum(l_orderkey % 4) as bigint) as strikeouts,
                       cast(sum(case when l_linenumber = 6 then 1 else 0 end) as bigint) as hbp, cast(sum(case when l_linenumber = 5 then 1 else 0 end) as bigint) as sac_flies
                from {lineitem} group by l_partkey) h) k
    """,
    "pitcher_seasons": """
        select *, '{"stats":[{"splits":[{"stat":{"gamesPlayed":' || cast(games as string) || ',"gamesStarted":' || cast(starts as string) || ',"inningsPitched":"' || innings_text
               || '","strikeOuts":' || cast(strikeouts as string) || ',"baseOnBalls":' || cast(walks as string) || case when pitcher_id % 5 = 0 then '' else ',"hitBatsmen":' || cast(hit_batters as string) end
               || ',"homeRuns":' || cast(home_runs as string) || ',"battersFaced":' || cast(batters_faced as string) || ',"hits":' || cast(hits as string) || ',"groundOuts":' || cast(outs as string)
               || ',"airOuts":' || cast(pitcher_id % 9 as string) || ',"era":"' || case when pitcher_id % 6 = 0 then '-.--' else '4.' || lpad(cast(pitcher_id % 100 as string), 2, '0') end || '"}}]}]}' as payload
        from (
          select pitcher_id, count(*) as games, cast(sum(is_starter) as bigint) as starts, cast(sum(outs) as bigint) as outs, cast(sum(strikeouts) as bigint) as strikeouts,
                 cast(sum(walks) as bigint) as walks, cast(sum(hit_batters) as bigint) as hit_batters, cast(sum(home_runs) as bigint) as home_runs,
                 cast(sum(batters_faced) as bigint) as batters_faced, cast(sum(walks + home_runs) as bigint) as hits,
                 case when pitcher_id % 13 = 0 then '12.3' else cast(cast((sum(outs) - sum(outs) % 3) / 3 as bigint) as string) || '.' || cast(sum(outs) % 3 as string) end as innings_text
          from appearances group by pitcher_id) p
    """,
    # immutable starter captures, some late, mislabelled or altered
    "starter_captures": """
        select a.game_pk, case when a.team = c.home_team then 'home' else 'away' end as side, a.pitcher_id, p.batters_faced, p.strikeouts,
               case when a.pitcher_id % 29 = 0 then 'lineup' else 'starter_stats' end as kind,
               cast(a.game_date as $TS) + interval '1' hour * cast(8 + a.pitcher_id % 12 as int) as captured_at, cast(a.game_date as $TS) + interval '1' hour * 18 as scheduled_start,
               cast(a.game_pk as string) || ':' || case when a.pitcher_id % 31 = 0 then 'bench' when a.team = c.home_team then 'home' else 'away' end || ':' || cast(a.pitcher_id as string) as identity,
               p.payload as raw_payload, case when a.game_pk % 37 = 0 then repeat('0', 64) else $SHA[p.payload]SHA$ end as raw_payload_sha256,
               cast(100 * p.strikeouts as double) / p.batters_faced + case when a.pitcher_id % 23 = 0 then 1 else 0 end as starter_k_rate
        from appearances a join contests c on c.game_pk = a.game_pk join pitcher_seasons p on p.pitcher_id = a.pitcher_id where a.is_starter = 1
    """,
    # the quote history as it arrives, with one book's rows delivered twice
    "quote_feed": """
        select * from quotes union all select * from quotes where sportsbook = 'B0'
    """,
    # quotes as they arrive over some deliveries: seen in the weeks before a game and after its start, some without a
    # time, those of every eleventh game one delivery late, and one book's again in the next delivery
    "quote_deliveries": """
        with seen as (
            select game_pk, sportsbook, market_type, selection, team, line, american_odds, event_date,
                   case when (game_pk + abs(american_odds)) % 19 = 0 then null
                        else cast(event_date as $TS) + interval '1' hour * cast((game_pk * 31 + abs(american_odds) * 17) % 401 - 360 as int) end as captured_at,
                   cast(floor((extract(year from event_date) - 1995) / 2) as int) + case when game_pk % 11 = 0 then 1 else 0 end as delivery
            from quotes)
        select * from seen
        union all
        select game_pk, sportsbook, market_type, selection, team, line, american_odds, event_date, captured_at, delivery + 1 from seen where sportsbook = 'B0'
    """,
    # a club's players as two captures name them, in different orders, and moves of players between clubs
    "roster_lines": """
        select 'T' || lpad(cast(c_nationkey as string), 2, '0') as team, c_custkey as player_id, c_mktsegment as status, capture,
               'capture-' || cast(capture as string) || '-' || cast(c_custkey % 7 as string) as file_path
        from {customer} cross join (select 1 as capture union all select 2) k
    """,
    "roster_moves": """
        select l_orderkey * 10 + l_linenumber as transaction_id, case when l_linenumber <> 5 then 'T' || lpad(cast(l_suppkey % 25 as string), 2, '0') end as from_team,
               'T' || lpad(cast(l_partkey % 25 as string), 2, '0') as to_team, l_linestatus as kind, l_extendedprice > 30000 as major
        from {lineitem} where l_returnflag = 'R'
        union all
        select l_orderkey * 10 + l_linenumber, case when l_linenumber <> 5 then 'T' || lpad(cast(l_suppkey % 25 as string), 2, '0') end, 'T' || lpad(cast(l_partkey % 25 as string), 2, '0'), l_linestatus, l_extendedprice > 30000
        from {lineitem} where l_returnflag = 'R' and l_linenumber = 2
    """,
    # pregame context: paired and game-level fields, weather text, venues and capture times
    "contexts": f"""
        select game_pk, game_date, away_team, home_team, start_ts, start_ts - interval '1' minute * cast(game_pk % 600 as int) as assessed_at,
               priority in ('1-URGENT', '2-HIGH') as lineups_confirmed, feed_status <> 'O' as probable_pitchers_confirmed, feed_status = 'F' as roster_loaded,
               case when game_pk % 4 = 0 then null else cast(game_pk % 60 + 45 as double) end as temperature_f,
               case game_pk % 7 when 0 then '12 mph, Out To CF' when 1 then '8.5 MPH, In From LF' when 2 then '9 mph, Left To Right' when 3 then 'Calm' when 4 then '7 mph, Varies' when 5 then '' end as wind_description,
               case game_pk % 11 when 0 then 'Roof Closed' when 1 then 'Dome' when 2 then 'Open' end as roof_status,
               case game_pk % 5 when 0 then 'Rain Showers' when 1 then 'Partly Cloudy' when 2 then 'Overcast' when 3 then 'Sunny' end as weather_condition,
               case when game_pk % 6 = 0 then null else game_pk % 30 end as venue_id,
               case when game_pk % 9 = 0 then null else cast(25 + game_pk % 23 as double) end as venue_latitude, -cast(70 + game_pk % 53 as double) as venue_longitude,
               cast(25 + (game_pk * 7) % 23 as double) as last_latitude, -cast(70 + (game_pk * 5) % 53 as double) as last_longitude,
               case when game_pk % 10 = 0 then null else cast(-4 - game_pk % 5 as double) end as venue_offset, cast(-4 - (game_pk * 3) % 5 as double) as last_offset,
               case when game_pk % 8 = 0 then null else cast(game_pk % 6 as double) end as rest_days, case when game_pk % 3 = 0 then null else cast(game_pk % 5 as double) end as games_last3,
               {_context_columns()}
        from schedule
    """,
    "lineups": """
        select distinct l_orderkey as game_pk, case when l_linenumber % 2 = 1 then 'home' else 'away' end as side, l_partkey as player_id
        from {lineitem} join contests on game_pk = l_orderkey
    """,
}


def mentions(name: str, text: str) -> bool:
    """Whether ``text`` reads the view, JSON keys of the same name aside."""
    return re.search(rf'(?<!")\b{name}\b(?!")', text) is not None


def view_order(names: set[str]) -> list[str]:
    """The requested views and the views they read, dependencies first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and mentions(other, VIEWS[name]):
                add(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if name in names:
            add(name)
    return wanted


def _spark_text(sql: str) -> str:
    # keep {table} placeholders for spark.sql and double every other brace, as in JSON literals
    sql = re.sub(r"\{(\w+)\}", r"<<\1>>", sql).replace("{", "{{").replace("}", "}}")
    sql = re.sub(r"<<(\w+)>>", r"{\1}", sql)
    sql = sql.replace("$TS", "timestamp_ntz").replace("$SHA[", "sha2(").replace("]SHA$", ", 256)")
    return re.sub(r"\$EACH\((\d+)\)", lambda m: f"lateral view explode(sequence(0, {int(m[1]) - 1})) d as draw_id", sql)


def _duckdb_text(sql: str) -> str:
    sql = sql.replace("$TS", "timestamp").replace("$SHA[", "sha256(").replace("]SHA$", ")")
    sql = re.sub(r"\$EACH\((\d+)\)", lambda m: f"cross join unnest(range({m[1]})) d(draw_id)", sql)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def duckdb_ctes(text: str) -> list[str]:
    """CTE definitions of every view that ``text`` mentions."""
    used = {name for name in VIEWS if mentions(name, text)}
    return [f"{name} as ({_duckdb_text(VIEWS[name])})" for name in view_order(used)]


_WRITTEN: dict[tuple[str, str, str], str] = {}
_SIZES: dict[tuple[str, str], int] = {}


class Tables:
    """The raw tables of one data folder and the domain tables derived from them.

    A domain table is written once per application as Parquet in the shared folder, so every
    query scans it with pruned columns instead of repeating the joins behind it.  One that only
    repeats the rows of another (``$EACH``) is never written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw_path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.raw_path(name))

    def size(self) -> int:
        """Rows of the largest raw table, counted once per application."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _SIZES:
            _SIZES[key] = self.raw("lineitem").count()
        return _SIZES[key]

    def path(self, name: str) -> str:
        """Where the domain table lies, writing it on first use."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            target = work_path(self.spark, name)
            self.view(name).write.parquet(target)
            _WRITTEN[key] = target
        return _WRITTEN[key]

    def view(self, name: str) -> DataFrame:
        """The domain table as a query over the written tables behind it."""
        text = VIEWS[name]
        parents = [v for v in VIEWS if v != name and mentions(v, text)]
        for parent in parents:
            text = re.sub(rf'(?<!")\b{parent}\b(?!")', f"{{{parent}}}", text)
        frames = {r: self.raw(r) for r in RAW_TABLES if f"{{{r}}}" in text}
        frames |= {parent: getattr(self, parent) for parent in parents}
        return self.spark.sql(_spark_text(text), **frames)

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several jobs of one application train on, written on first use."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            target = work_path(self.spark, name)
            build().write.parquet(target)
            _WRITTEN[key] = target
        return self.spark.read.parquet(_WRITTEN[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if "$EACH" in VIEWS[name]:
            return self.view(name)  # repeats written rows: cheaper to repeat where they are read than to write
        return self.spark.read.parquet(self.path(name))
