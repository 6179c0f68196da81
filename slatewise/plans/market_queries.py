"""Quote validation, state, pricing, valuation and ranking queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.functions import odds
from slatewise.operators import ledger, market
from slatewise.plans import shared
from slatewise.plans.registry import query

DEC = "case when {o} > 0 then 1 + {o} / 100.0 else 1 + 100.0 / abs({o}) end"
KEY = "cast(game_pk as varchar) || '|' || market_type || '|' || selection || '|' || coalesce(cast(cast(line as decimal(12,2)) as varchar), '-') || '|' || coalesce(team, '-')"
QKEY = f"lower(sportsbook) || '|' || {KEY}"


def dec(o: str) -> str:
    return "(" + DEC.format(o=o) + ")"


def to_american(price: str) -> str:
    return f"(case when {price} - 1 >= 1 then cast(round_even(({price} - 1) * 100.0, 0) as int) when {price} > 1 then cast(round_even(-100.0 / ({price} - 1), 0) as int) end)"


def price_at(win: str, push: str, roi: float) -> str:
    price = f"((1.0 + {roi} - {push}) / nullif({win}, 0))"
    return f"(case when {price} <= 1 then -100000 else {to_american(price)} end)"


@query(
    "odds_conversions",
    "game_pk:i american_odds:i decimal_odds:d implied:d round_trip:i from_probability:i parsed_american:i parsed_decimal:i",
    f"""q as (select game_pk, american_odds, line, {dec('american_odds')} as price, game_pk % 997 + 1 as k from quotes)
    => select game_pk, american_odds, price as decimal_odds, 1 / price as implied, {to_american('price')} as round_trip,
       case when k / 1000.0 >= 0.5 then cast(round_even(-100.0 * (k / 1000.0) / (1 - k / 1000.0), 0) as int) else cast(round_even(100.0 * (1 - k / 1000.0) / (k / 1000.0), 0) as int) end as from_probability,
       american_odds as parsed_american, {to_american('(1.0 + k / 100.0)')} as parsed_decimal from q""",
)
def odds_conversions(t):
    o, k = F.col("american_odds"), F.col("game_pk") % 997 + 1
    text = F.when(o > 0, F.concat(F.lit(" +"), o.cast("string"))).otherwise(o.cast("string"))
    typed = F.concat((1 + F.floor(k / 100)).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))
    return t.quotes.select(
        "game_pk", "american_odds", odds.american_to_decimal(o).alias("decimal_odds"), odds.implied_probability(o).alias("implied"),
        odds.decimal_to_american(odds.american_to_decimal(o)).alias("round_trip"), odds.probability_to_american(k / 1000.0).alias("from_probability"),
        odds.parse_odds(text, F.lit("American")).alias("parsed_american"), odds.parse_odds(typed, F.lit("decimal")).alias("parsed_decimal"),
    )


@query(
    "no_vig_probabilities",
    "sequence:i away_no_vig:d home_no_vig:d",
    f"""p as (select sequence, 1 / {dec('away_odds')} as a, 1 / {dec('home_odds')} as h from ledger where event_type = 'prediction')
    => select sequence, a / (a + h) as away_no_vig, h / (a + h) as home_no_vig from p""",
)
def no_vig_probabilities(t):
    return market.two_way_probabilities(t.ledger.filter("event_type = 'prediction'"))


@query(
    "quote_validate",
    "row_id:i reason:s market_type:s sportsbook:s selection:s team:s line:d american_odds:i captured_second:i",
    """q as (select *, lower(trim(market_type)) as mt, upper(trim(selection)) as sel, nullif(upper(trim(team)), '') as tm from raw_quotes)
    => select row_id, mt as market_type, trim(sportsbook) as sportsbook, sel as selection, tm as team, line, american_odds,
    epoch(cast(substr(captured_at, 1, 19) as timestamp)) as captured_second,
    case when mt not in ('moneyline', 'run_line', 'game_total', 'team_total') then 'unknown_market_type' when game_pk <= 0 then 'game_pk_not_positive'
      when trim(sportsbook) = '' then 'sportsbook_missing' when abs(american_odds) < 100 then 'invalid_american_odds'
      when mt = 'moneyline' and line is not null then 'moneyline_with_line' when mt = 'moneyline' and tm is not null and tm <> sel then 'moneyline_team_mismatch'
      when mt <> 'moneyline' and line is null then 'line_missing' when mt = 'run_line' and sel in ('OVER', 'UNDER') then 'run_line_needs_team'
      when mt in ('game_total', 'team_total') and sel not in ('OVER', 'UNDER') then 'total_needs_over_under'
      when mt = 'game_total' and tm is not null then 'game_total_with_team' when mt = 'team_total' and tm is null then 'team_total_needs_team'
      when right(captured_at, 1) <> 'Z' then 'timestamp_without_zone' end as reason from q""",
)
def quote_validate(t):
    return market.quote_validate(t.raw_quotes).withColumn("captured_second", F.unix_timestamp("captured_at"))


@query(
    "moneyline_validate",
    "row_id:i status:s error:s day:s away:s home:s pk:i away_price:i home_price:i",
    f"""e as (select *, lower(trim(include)) as flag, try_cast(trim(game_date) as date) as day, upper(trim(away_team)) as away, upper(trim(home_team)) as home,
      try_cast(trim(game_pk) as double) as pkn from entries),
    n as (select *, case when upper(trim(away_odds)) = 'EVEN' then 100.0 else try_cast(replace(away_odds, ',', '') as double) end as an, try_cast(replace(home_odds, ',', '') as double) as hn,
      try_cast(replace(away_odds, ',', '.') as double) as ad, try_cast(replace(home_odds, ',', '.') as double) as hd, case when pkn = floor(pkn) then cast(pkn as bigint) end as pk from e),
    c as (select *, case when odds_format = 'decimal' then {to_american('ad')} when an = floor(an) and abs(an) >= 100 then cast(an as int) end as away_price,
      case when odds_format = 'decimal' then {to_american('hd')} when hn = floor(hn) and abs(hn) >= 100 then cast(hn as int) end as home_price from n),
    f as (select *, flag = 'skip' or (flag <> 'maybe' and away_odds = '' and home_odds = '') as skipped,
      case when flag = 'maybe' then 'invalid_include' when flag = 'skip' or (away_odds = '' and home_odds = '') then null when away_odds = '' or home_odds = '' then 'both_prices_required'
      when game_date = '' or away = '' or home = '' then 'date_and_teams_required' when day is null then 'invalid_game_date' when away_price is null or home_price is null then 'invalid_odds'
      when game_pk <> '' and pk is null then 'game_pk_not_integer' when pk <= 0 then 'game_pk_not_positive' end as err from c),
    k as (select *, case when err is null and not skipped then coalesce('pk' || pk, day || away || '/' || home) end as ek from f),
    d as (select *, case when ek is not null and row_number() over (partition by ek order by row_id) > 1 then case when pk is not null then 'duplicate_game_pk' else 'duplicate_matchup' end else err end as error from k)
    => select row_id, case when error is not null then 'ERROR' when skipped then 'SKIPPED' else 'INCLUDED' end as status, error, day, away, home, pk, away_price, home_price from d""",
)
def moneyline_validate(t):
    return market.moneyline_validate(t.entries)


LATEST = f"""cur as (select *, {QKEY} as quote_key from quotes qualify row_number() over (partition by {QKEY} order by captured_at desc, american_odds desc) = 1)"""


@query("latest_per_key", "quote_key:s american_odds:i captured_second:i", f"{LATEST} => select quote_key, american_odds, epoch(captured_at) as captured_second from cur")
def latest_per_key(t):
    return market.current_quotes(t.quotes).withColumn("captured_second", F.unix_timestamp(F.col("captured_at").cast("timestamp")))


@query("active_sportsbooks", "sportsbook:s", "=> select distinct sportsbook from quotes")
def active_sportsbooks(t):
    return market.active_sportsbooks(t.quotes)


@query(
    "provider_snapshot_diff",
    "quote_key:s game_pk:i sportsbook:s old_odds:i new_odds:i status:s active_odds:i",
    f"""k as (select *, {QKEY} as quote_key, captured_at >= event_date + interval 60 day as late from quotes),
    l as (select * from k qualify row_number() over (partition by quote_key, late order by captured_at desc, american_odds desc) = 1),
    j as (select coalesce(o.quote_key, n.quote_key) as quote_key, coalesce(o.game_pk, n.game_pk) as game_pk, coalesce(o.sportsbook, n.sportsbook) as sportsbook,
       o.american_odds as old_odds, n.american_odds as new_odds from (select * from l where not late) o full join (select * from l where late) n on o.quote_key = n.quote_key),
    s as (select *, case when new_odds is null then case when game_pk in (select game_pk from l where late) then 'REMOVED' else 'PRESERVED' end
       when old_odds is null then 'ADDED' when old_odds <> new_odds then 'REPRICED' else 'UNCHANGED' end as status from j)
    => select *, case status when 'REMOVED' then null when 'PRESERVED' then old_odds else new_odds end as active_odds from s""",
)
def provider_snapshot_diff(t):
    late = F.col("captured_at") >= F.expr("cast(event_date as timestamp_ntz) + interval '60' day")
    incoming = market.current_quotes(t.quotes.filter(late))
    return market.provider_snapshot_diff(market.current_quotes(t.quotes.filter(~late)), incoming, incoming)


PRICED = """
hist as (select game_pk, away_runs, home_runs, count(*) as n from draws group by game_pk, away_runs, home_runs),
cell as (select q.*, h.n, h.away_runs as ar, h.home_runs as hr, case when q.selection = q.home_team then hr - ar else ar - hr end as side_margin,
   case q.market_type when 'game_total' then ar + hr when 'team_total' then case when q.team = q.home_team then hr else ar end end as points
   from (select distinct * from quotes) q join hist h using (game_pk)),
marg as (select *, case market_type when 'moneyline' then side_margin when 'run_line' then side_margin + line else case when selection = 'OVER' then points - line else line - points end end as m from cell),
priced as (select game_pk, sportsbook, market_type, selection, team, line, american_odds, captured_at, event_date, home_team, away_team,
   case when market_type = 'moneyline' then (sum(n) filter (where m > 0)  + 0.5 * coalesce(sum(n) filter (where m = 0), 0)) / sum(n) else coalesce(sum(n) filter (where m > 0), 0) / sum(n) end as win_probability,
   case when market_type = 'moneyline' then 0.0 else coalesce(sum(n) filter (where m = 0), 0) / sum(n) end as push_probability from marg group by game_pk, sportsbook, market_type, selection, team, line, american_odds, captured_at, event_date, home_team, away_team)
"""


@query(
    "price_quotes_from_draws",
    "game_pk:i sportsbook:s market_type:s selection:s team:s line:d american_odds:i win_probability:d push_probability:d",
    f"{PRICED} => select * from priced",
)
def price_quotes_from_draws(t):
    return market.price_quotes(t.quotes, shared.score_cells(t))


@query(
    "quote_snapshot_join",
    "quote_key:s american_odds:i draws:i",
    f"{LATEST} => select quote_key, american_odds, d.n as draws from cur join (select game_pk, count(*) as n from draws group by game_pk) d using (game_pk)",
)
def quote_snapshot_join(t):
    return market.quote_snapshot_join(t.quotes, t.draws)


def valued_sql(source: str, buffer: float, flags: str = "true as fresh, false as conflict") -> str:
    win = f"least(greatest(0.0, win_probability - {buffer}), 1 - push_probability)"
    return f"""cons as (select *, {win} as w, {flags} from {source}),
    roi as (select *, w * ({dec('american_odds')} - 1) - greatest(0.0, 1 - w - push_probability) as expected_roi, (1 - push_probability) / {dec('american_odds')} as break_even from cons),
    valued as (select *, w as conservative_probability, w - break_even as probability_edge, {price_at('w', 'push_probability', 0.0)} as fair_odds, {price_at('w', 'push_probability', 0.02)} as playable_through,
      case when not fresh then 'PASS_STALE' when conflict then 'PASS_CONFLICT' when expected_roi >= 0.02 then 'PLAY' when expected_roi > 0 then 'MARGINAL' else 'NO_EDGE' end as status from roi)"""


FLAGS = "captured_at >= event_date as fresh, event_date < date '1995-06-01' as conflict"
VALUE_COLUMNS = "expected_roi:d break_even:d probability_edge:d fair_odds:i playable_through:i status:s"


@query(
    "quote_valuation",
    "game_pk:i sportsbook:s market_type:s selection:s team:s line:d american_odds:i captured_at:s conservative_probability:d " + VALUE_COLUMNS,
    f"{PRICED}, {valued_sql('priced', 0.01, FLAGS)} => select * exclude (captured_at), strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at from valued",
)
def quote_valuation(t):
    priced = market.price_quotes(t.quotes, shared.score_cells(t)).withColumns(
        {"fresh": F.col("captured_at") >= F.col("event_date").cast("timestamp_ntz"), "conflict": F.col("event_date") < F.lit("1995-06-01").cast("date")}
    )
    return market.value_quotes(priced, buffer=0.01).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))


LINES = (7.5, 8.0, 8.5, 9.0, 9.5)


@query(
    "line_frontier",
    "game_pk:i line:d selection:s win_probability:d push_probability:d fair_odds:i playable_through:i",
    f"""pts as (select game_pk, l.line, s.selection, avg(case when (s.selection = 'OVER' and away_runs + home_runs > l.line) or (s.selection = 'UNDER' and away_runs + home_runs < l.line) then 1.0 else 0.0 end) as w,
      avg(case when away_runs + home_runs = l.line then 1.0 else 0.0 end) as p from draws cross join (values {', '.join(f'({x})' for x in LINES)}) l(line) cross join (values ('OVER'), ('UNDER')) s(selection) group by all)
    => select game_pk, line, selection, w as win_probability, p as push_probability, {price_at('w', 'p', 0.0)} as fair_odds, {price_at('w', 'p', 0.02)} as playable_through from pts""",
)
def line_frontier(t):
    return market.line_frontier(t.draws, LINES)


SUMMARY = ("away_win", "home_win", "tie", "mean_away", "mean_home", "median_away", "median_home", "shutout", "team_ten_plus", "fifteen_plus", "margin_five_plus", "one_run")


@query(
    "score_summary",
    "game_pk:i " + " ".join(f"{c}:d" for c in SUMMARY),
    """=> select game_pk, avg(case when away_runs > home_runs then 1.0 else 0 end) as away_win, avg(case when home_runs > away_runs then 1.0 else 0 end) as home_win,
    avg(case when away_runs = home_runs then 1.0 else 0 end) as tie, avg(away_runs) as mean_away, avg(home_runs) as mean_home, median(away_runs) as median_away, median(home_runs) as median_home,
    avg(case when least(away_runs, home_runs) = 0 then 1.0 else 0 end) as shutout, avg(case when greatest(away_runs, home_runs) >= 10 then 1.0 else 0 end) as team_ten_plus,
    avg(case when away_runs + home_runs >= 15 then 1.0 else 0 end) as fifteen_plus, avg(case when abs(away_runs - home_runs) >= 5 then 1.0 else 0 end) as margin_five_plus,
    avg(case when abs(away_runs - home_runs) = 1 then 1.0 else 0 end) as one_run from draws group by game_pk""",
)
def score_summary(t):
    return market.score_summary(t.draws)


BEST = f"""best as (select *, {KEY} as market_key from {{src}} qualify row_number() over (partition by {KEY} order by {dec('american_odds')} desc, sportsbook) = 1)"""


@query(
    "best_quote_per_market",
    "market_key:s sportsbook:s american_odds:i",
    BEST.format(src="quotes") + " => select market_key, sportsbook, american_odds from best",
)
def best_quote_per_market(t):
    return market.best_quote_per_market(t.quotes)


def best_priced(t):
    return market.best_priced(t.quotes.drop("captured_at", "event_date"), shared.score_cells(t))


@query(
    "rank_high_probability",
    "market_key:s sportsbook:s american_odds:i win_probability:d push_probability:d",
    f"{PRICED}, {BEST.format(src='priced')} => select * from best",
)
def rank_high_probability(t):
    return market.rank_high_probability(best_priced(t))


@query(
    "rank_high_probability_top",
    "market_key:s sportsbook:s american_odds:i win_probability:d push_probability:d",
    f"{PRICED}, {BEST.format(src='priced')} => select * from best order by win_probability desc, push_probability, game_pk desc, market_key desc limit 100",
)
def rank_high_probability_top(t):
    return market.rank_high_probability(best_priced(t), 100)


@query(
    "rank_best_value",
    "market_key:s sportsbook:s american_odds:i conservative_probability:d " + VALUE_COLUMNS,
    f"{PRICED}, {BEST.format(src='priced')}, {valued_sql('best', 0.0)} => select * from valued where status = 'PLAY' order by expected_roi desc, probability_edge desc, w desc, game_pk desc, market_key desc limit 5",
)
def rank_best_value(t):
    return market.rank_best_value(best_priced(t))


@query(
    "model_only_probabilities",
    "game_pk:i selection:s win_probability:d rank:i",
    """g as (select game_pk, away_team, home_team, avg(case when away_runs > home_runs then 1.0 when away_runs = home_runs then 0.5 else 0.0 end) as p from draws group by all),
    s as (select game_pk, away_team as selection, p as win_probability from g union all select game_pk, home_team, 1 - p from g)
    => select *, row_number() over (order by win_probability desc, game_pk desc, selection desc) as rank from s""",
)
def model_only_probabilities(t):
    return market.model_only_probabilities(t.draws)


TOP_PICKS = 4


@query(
    "parlay_pairs",
    "slate:s first_game:i second_game:i combined_odds:i joint_probability:d break_even_probability:d edge:d",
    f"""l as (select cast(game_date as varchar) as slate, game_pk, greatest(home_probability, 1 - home_probability) as p, case when home_probability >= 0.5 then home_odds else away_odds end as o,
      row_number() over (partition by game_date order by greatest(home_probability, 1 - home_probability) desc, game_pk) as rank from last_predictions where true),
    j as (select a.slate, a.game_pk as first_game, b.game_pk as second_game, {to_american(f"({dec('a.o')} * {dec('b.o')})")} as combined_odds, a.p * b.p as joint_probability
      from l a join l b on a.slate = b.slate and a.rank < b.rank and b.rank <= {TOP_PICKS})
    => select *, 1 / {dec('combined_odds')} as break_even_probability, joint_probability - 1 / {dec('combined_odds')} as edge from j""",
)
def parlay_pairs(t):
    first = ledger.latest_predictions(t.ledger)
    p = F.greatest(F.col("home_probability"), 1 - F.col("home_probability"))
    picks = first.select(
        F.col("game_date").cast("string").alias("slate"), "game_pk", p.alias("pick_probability"),
        F.when(F.col("home_probability") >= 0.5, F.col("home_odds")).otherwise(F.col("away_odds")).alias("pick_odds"),
    )
    # Spark keeps the best of each slate in every task before the shuffle
    best = Window.partitionBy("slate").orderBy(F.desc("pick_probability"), F.asc("game_pk"))
    ranked = picks.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP_PICKS)
    return market.parlay_pairs(ranked, TOP_PICKS)
