"""Settlement, scorecards, abstention audits and ledger integrity queries."""

from slatewise.operators import ledger
from slatewise.plans.history_queries import doubles
from slatewise.plans.market_queries import dec
from slatewise.plans.registry import query

JOINED = """
lp as (select * from ledger where event_type = 'prediction' qualify row_number() over (partition by game_pk order by recorded_at desc, sequence desc) = 1),
lo as (select game_pk, home_won as won from ledger where event_type = 'outcome' qualify row_number() over (partition by game_pk order by recorded_at desc, sequence desc) = 1),
lc as (select game_pk, closing_home_implied as closing from ledger where event_type = 'closing_line' qualify row_number() over (partition by game_pk order by recorded_at desc, sequence desc) = 1),
joined as (select lp.* exclude (home_won, closing_home_implied), won as home_won, closing as closing_home_implied from lp join lo using (game_pk) left join lc using (game_pk))
"""
SETTLED = (
    JOINED
    + f""", settled as (
  select *, case when production_home_probability >= 0.5 then home_team else away_team end as production_pick, case when home_probability >= 0.5 then home_team else away_team end as shadow_pick,
    (production_home_probability >= 0.5) = (home_won = 1) as production_correct, (home_probability >= 0.5) = (home_won = 1) as shadow_correct,
    pow(production_home_probability - home_won, 2) as production_brier, pow(home_probability - home_won, 2) as shadow_brier,
    -ln(case when home_won = 1 then production_home_probability else 1 - production_home_probability end) as production_log_loss,
    -ln(case when home_won = 1 then home_probability else 1 - home_probability end) as shadow_log_loss,
    case when production_home_probability >= 0.5 then home_odds else away_odds end as offered_pick_odds,
    case when (production_home_probability >= 0.5) = (home_won = 1) then {dec('(case when production_home_probability >= 0.5 then home_odds else away_odds end)')} - 1 else -1.0 end as realized_roi,
    case when production_home_probability >= 0.5 then closing_home_implied - offered_home_implied else offered_home_implied - closing_home_implied end as closing_line_value
  from joined)"""
)


@query(
    "latest_event_join",
    "game_pk:i home_probability:d production_home_probability:d home_odds:i selection_status:s home_won:i closing_home_implied:d",
    f"{JOINED} => select * from joined",
)
def latest_event_join(t):
    return ledger.latest_event_join(t.ledger)


@query(
    "settle_predictions",
    "game_pk:i production_pick:s shadow_pick:s production_correct:b shadow_correct:b offered_pick_odds:i "
    + doubles(("production_brier", "shadow_brier", "production_log_loss", "shadow_log_loss", "realized_roi", "closing_line_value")),
    f"{SETTLED} => select * from settled",
)
def settle_predictions(t):
    return ledger.settle_predictions(t.ledger)


@query(
    "settlement_summary",
    "status:s settled_games:i disagreements:i "
    + doubles(f"{t}_{m}" for t in ("production", "shadow") for m in ("accuracy", "brier", "log_loss"))
    + " recommendation_roi:d average_closing_line_value:d",
    f"""{SETTLED} => select case when count(*) > 0 then 'PASS' else 'NO_SETTLED_GAMES' end as status, count(*) as settled_games, avg(cast(production_correct as int)) as production_accuracy,
    avg(cast(shadow_correct as int)) as shadow_accuracy, avg(production_brier) as production_brier, avg(shadow_brier) as shadow_brier, avg(production_log_loss) as production_log_loss,
    avg(shadow_log_loss) as shadow_log_loss, avg(realized_roi) as recommendation_roi, avg(closing_line_value) as average_closing_line_value,
    sum(case when production_pick <> shadow_pick then 1 else 0 end) as disagreements from settled""",
)
def settlement_summary(t):
    return ledger.settlement_summary(ledger.settle_predictions(t.ledger))


@query(
    "forecast_feedback",
    "predictions:i graded:i " + doubles(("brier", "log_loss", "accuracy", "mean_probability_clv", "positive_clv_rate")),
    JOINED
    + """, r as (select lp.home_probability as p, lp.offered_home_implied as offered, won as y, closing from lp left join lo using (game_pk) left join lc using (game_pk))
    => select count(*) as predictions, count(y) as graded, avg(pow(p - y, 2)) as brier, avg(case when y = 1 then -ln(p) when y = 0 then -ln(1 - p) end) as log_loss,
       avg(case when y is not null then case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end end) as accuracy, avg(closing - offered) as mean_probability_clv,
       avg(case when closing is not null then case when closing > offered then 1.0 else 0.0 end end) as positive_clv_rate from r""",
)
def forecast_feedback(t):
    return ledger.forecast_feedback(ledger.prediction_records(t.ledger))


@query(
    "track_scorecard",
    "track:s n:i accuracy:d brier:d log_loss:d",
    JOINED
    + """, l as (select 'production' as track, production_home_probability as p, home_won as y from joined union all select 'shadow', home_probability, home_won from joined
       union all select 'closing', closing_home_implied, home_won from joined where closing_home_implied is not null)
    => select track, count(*) as n, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy, avg(pow(p - y, 2)) as brier, avg(-ln(case when y = 1 then p else 1 - p end)) as log_loss from l group by track""",
)
def track_scorecard(t):
    tracks = {"production": "production_home_probability", "shadow": "home_probability", "closing": "closing_home_implied"}
    return ledger.track_scorecard(ledger.latest_event_join(t.ledger), tracks)


@query(
    "cohort_counts",
    "cohort:s games:i",
    f"{JOINED} => select coalesce(model_version, 'unknown') || '|' || coalesce(candidate_commit, 'unknown') || '|' || coalesce(adaptive_overlay_sha256, 'none') as cohort, count(*) as games from joined group by cohort",
)
def cohort_counts(t):
    return ledger.cohort_counts(ledger.latest_event_join(t.ledger))


AUDITED = """
a as (select p.game_pk, p.selection_status as status, p.selection_reasons as reasons, (p.home_probability >= 0.5) = (o.home_won = 1) as ok from
  (select * from ledger where event_type = 'prediction' qualify row_number() over (partition by game_pk order by sequence desc) = 1) p
  join (select * from ledger where event_type = 'outcome') o using (game_pk))
"""
AUDIT_COUNTS = "graded_games filtered_games eligible_games raw_wins eligible_wins false_passes helpful_passes policy_evaluable_games unclassifiable_games graded_games_remaining filtered_games_remaining".split()
AUDIT_RATES = "raw_accuracy eligible_accuracy filtered_raw_accuracy helpful_pass_rate coverage overall_recommendation_coverage accuracy_lift".split()


@query(
    "abstention_audit",
    " ".join(f"{c}:i" for c in AUDIT_COUNTS) + " " + doubles(AUDIT_RATES) + " evidence_status:s",
    AUDITED
    + """, s as (select count(*) as graded_games, count(*) filter (where status = 'PASS') as filtered_games, count(*) filter (where status = 'ELIGIBLE') as eligible_games,
      count(*) filter (where ok) as raw_wins, count(*) filter (where ok and status = 'ELIGIBLE') as eligible_wins, count(*) filter (where ok and status = 'PASS') as false_passes,
      count(*) filter (where not ok and status = 'PASS') as helpful_passes, count(*) filter (where status in ('PASS', 'ELIGIBLE')) as policy_evaluable_games from a)
    => select *, graded_games - policy_evaluable_games as unclassifiable_games, greatest(0, 100 - policy_evaluable_games) as graded_games_remaining, greatest(0, 30 - filtered_games) as filtered_games_remaining,
       raw_wins / graded_games as raw_accuracy, eligible_wins / eligible_games as eligible_accuracy, false_passes / filtered_games as filtered_raw_accuracy, helpful_passes / filtered_games as helpful_pass_rate,
       eligible_games / policy_evaluable_games as coverage, eligible_games / graded_games as overall_recommendation_coverage, eligible_wins / eligible_games - raw_wins / graded_games as accuracy_lift,
       case when policy_evaluable_games >= 100 and filtered_games >= 30 then 'READY_FOR_REVIEW' else 'PENDING' end as evidence_status from s""",
)
def abstention_audit(t):
    return ledger.abstention_audit(t.ledger)


@query(
    "abstention_by_reason",
    "reason:s games:i raw_wins:i raw_losses:i helpful_pass_rate:d",
    AUDITED
    + """, r as (select ok, unnest(string_split(reasons, ';')) as reason from a) => select reason, count(*) as games, count(*) filter (where ok) as raw_wins, count(*) filter (where not ok) as raw_losses,
    count(*) filter (where not ok) / count(*) as helpful_pass_rate from r where reason <> '' group by reason""",
)
def abstention_by_reason(t):
    return ledger.abstention_by_reason(t.ledger)


CHAIN = """
placed as (select stream, sequence, count(*) as copies, min(event_sha256) as linked from evidence group by stream, sequence),
lagged as (select e.*, b.linked as ph, p.copies, row_number() over (partition by e.stream, e.event_sha256 order by e.sequence) as nth
   from evidence e join placed p using (stream, sequence) left join placed b on b.stream = e.stream and b.sequence = e.sequence - 1),
marked as (select *, case when copies > 1 then 'repeated_sequence' when sequence > 1 and ph is null then 'sequence_gap' when previous_event_sha256 is distinct from ph then 'broken_chain' when nth > 1 then 'duplicate_hash'
   when event_sha256 <> sha256(schema_version || '|' || sequence || '|' || event_type || '|' || game_pk || '|' || recorded_at || '|' || scheduled_start || '|' || source || '|' || coalesce(snapshot_sha256, '~') || '|' || provenance || '|' || payload || '|' || coalesce(previous_event_sha256, '')) then 'hash_mismatch'
   when schema_version <> 1 then 'unsupported_schema' end as problem from lagged),
chain as (select stream, count(*) as events, min(sequence) filter (where problem is not null) as first_break, arg_min(problem, sequence) filter (where problem is not null) as problem from marked group by stream)
"""


@query("hash_chain_verify", "stream:i events:i first_break:i problem:s status:s", f"{CHAIN} => select *, case when first_break is null then 'PASS' else 'FAIL' end as status from chain")
def hash_chain_verify(t):
    return ledger.hash_chain_verify(t.view("evidence"))  # read once: not written, and it lies by stream already


FORBIDDEN = "list_filter(regexp_extract_all(payload, '\"([^\"]*)\":', 1), lambda k: lower(k) in (" + ", ".join(f"'{k}'" for k in ledger.OUTCOME_KEYS) + "))[1]"


@query("leakage_key_scan", "stream:i sequence:i forbidden_key:s", f"=> select stream, sequence, {FORBIDDEN} as forbidden_key from evidence where event_type = 'prediction'")
def leakage_key_scan(t):
    return ledger.leakage_key_scan(t.evidence)


@query(
    "event_payload_validate",
    "stream:i sequence:i event_type:s reason:s",
    f"""j as (select *, payload ->> '$.model_version' as mv, cast(payload ->> '$.home_probability' as double) as hp, cast(payload ->> '$.away_probability' as double) as ap,
      cast(payload ->> '$.closing_home_implied' as double) as cp, payload ->> '$.home_won' as hw from evidence)
    => select stream, sequence, event_type, case when game_pk <= 0 then 'game_pk_not_positive' when event_type <> 'outcome' and recorded_at > scheduled_start then 'recorded_after_start' when event_type = 'outcome' and recorded_at < scheduled_start then 'outcome_before_start'
      when event_type = 'prediction' and {FORBIDDEN} is not null then 'outcome_like_field' when event_type = 'prediction' and mv is null then 'missing_field'
      when event_type = 'prediction' and (hp < 0 or hp > 1 or ap < 0 or ap > 1) then 'invalid_probability' when event_type = 'prediction' and abs(hp + ap - 1) > 1e-6 then 'probabilities_do_not_sum'
      when event_type = 'closing_line' and not cp between 0 and 1 then 'invalid_closing_line' when event_type = 'outcome' and hw not in ('0', '1') then 'outcome_not_binary'
      when not regexp_full_match(snapshot_sha256, '[0-9a-f]{{64}}') then 'invalid_snapshot_hash' end as reason from j""",
)
def event_payload_validate(t):
    return ledger.event_payload_validate(t.evidence)


ISSUES = f"""
pj as (select *, provenance ->> '$.market_input' as mi, provenance ->> '$.live_feed' as lf, payload ->> '$.away_starter_id' as aid, payload ->> '$.home_starter_id' as hid,
   payload ->> '$.away_starter_snapshot_sha256' as ah, payload ->> '$.home_starter_snapshot_sha256' as hh, (payload ->> '$.away_team') || (payload ->> '$.home_team') as pair from evidence),
issues as (
  select game_pk, sequence, 'target_leakage' as category, 'outcome-like field' as detail from pj where event_type = 'prediction' and {FORBIDDEN} is not null
  union all select game_pk, sequence, 'provenance', 'no valid snapshot hash' from pj where event_type = 'prediction' and not coalesce(regexp_full_match(snapshot_sha256, '[0-9a-f]{{64}}'), false)
  union all select game_pk, sequence, 'provenance', 'missing provenance keys' from pj where event_type = 'prediction' and mi is null
  union all select game_pk, sequence, 'provenance', 'placeholder provenance values' from pj where event_type = 'prediction' and lower(lf) = 'neutral_placeholder'
  union all select game_pk, sequence, 'provenance', 'invalid away starter id' from pj where event_type = 'prediction' and cast(aid as bigint) <= 0
  union all select game_pk, sequence, 'provenance', 'away starter without snapshot hash' from pj where event_type = 'prediction' and aid is not null and ah is null
  union all select game_pk, sequence, 'provenance', 'home starter snapshot without id' from pj where event_type = 'prediction' and hid is null and hh is not null
  union all select game_pk, null, 'schedule_integrity', 'conflicting teams' from pj where event_type = 'prediction' group by game_pk having count(distinct pair) > 1)
"""


@query("evidence_issues", "game_pk:i sequence:i category:s detail:s", f"{ISSUES} => select * from issues")
def evidence_issues(t):
    return ledger.evidence_issues(t.view("evidence"))  # the digests of the chain take no part: neither made nor written


#: The audit's gates, behind ISSUES and CHAIN.
AUDIT = """g as (select game_pk, max(case when event_type = 'prediction' then 1 else 0 end) as p, max(case when event_type = 'outcome' then 1 else 0 end) as o, max(case when event_type = 'closing_line' then 1 else 0 end) as c from evidence group by game_pk),
seen as (select sum(p * o) as graded, sum(p * o * c) as closed, (select count(*) from chain where first_break is not null) as broken from g),
audit as (select 'prospective_games' as gate, case when broken > 0 then 'FAIL' when graded >= 500 then 'PASS' else 'PENDING' end as status, graded as observed from seen
       union all select 'closing_line_value_tracking', case when broken > 0 or closed <> graded then 'FAIL' else 'PASS' end, closed from seen
       union all select 'schedule_integrity_passed', case when broken > 0 or n > 0 then 'FAIL' else 'PASS' end, n from seen, (select count(*) as n from issues where category = 'schedule_integrity')
       union all select 'target_leakage_tests_passed', case when broken > 0 or n > 0 then 'FAIL' else 'PASS' end, n from seen, (select count(*) as n from issues where category = 'target_leakage')
       union all select 'point_in_time_provenance', case when broken > 0 or n > 0 then 'FAIL' else 'PASS' end, n from seen, (select count(*) as n from issues where category = 'provenance'))"""


@query("evidence_audit", "gate:s status:s observed:i", f"{ISSUES}, {CHAIN}, {AUDIT} => select * from audit")
def evidence_audit(t):
    return ledger.evidence_audit(t.evidence)
