"""Metric, calibration, fold, bootstrap and gate queries over the matched predictions."""

from slatewise.operators import ensemble, history, ledger, metrics, resampling, scoring
from slatewise.plans.history_queries import SCORED, doubles
from slatewise.plans.ledger_queries import AUDIT, CHAIN, ISSUES
from slatewise.plans import shared
from slatewise.plans.registry import query

METRIC_COLUMNS = "n_total:i n:i " + doubles(metrics.METRICS[2:])
TRACKS = """
rows as (
  select *, case when track = 'baseline' then baseline_probability else candidate_probability end as p0
  from predictions cross join (values ('baseline'), ('candidate')) v(track))
"""


def metrics_sql(keys: str, source: str, bins: int, y: str = "y", p: str = "p", name: str = "measured") -> str:
    """CTE of all metrics per key by direct formulas; AUC by comparing average ranks."""
    k = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    part = f"partition by {keys}" if keys else ""
    using = f"using ({keys})" if keys else "on true"
    return f"""
    {name}_rows as (select {k} {y} as y, greatest(1e-6, least(1 - 1e-6, {p})) as p from {source}),
    {name}_ranked as (
      select *, len(list_filter(range(1, {bins}), lambda i: p >= i * cast({1.0 / bins} as double))) as bin,
             rank() over ({part} order by p) + (count(*) over (partition by {k} p) - 1) / 2.0 as avg_rank from {name}_rows),
    {name}_bins as (select {k} bin, count(*) as bn, abs(avg(p) - avg(y)) as gap from {name}_ranked group by {k} bin),
    {name}_cal as (select {k} sum(bn * gap) / sum(bn) as ece, max(gap) as mce from {name}_bins {group}),
    {name} as (
      select * from (
        select {k} count(*) as n_total, count(*) as n, 1.0 as coverage, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy,
               avg((p - y) * (p - y)) as brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss,
               case when sum(y) > 0 and sum(1 - y) > 0 then (sum(case when y = 1 then avg_rank end) - sum(y) * (sum(y) + 1) / 2.0) / (cast(sum(y) as double) * sum(1 - y)) end as auc,
               avg(p) as mean_probability, avg(y) as observed_rate
        from {name}_ranked {group}) a join {name}_cal {using})"""


ROWS_SQL = "pred as (select a_win as y, baseline_probability as b, candidate_probability as c, * from predictions)"
BASE = ROWS_SQL + ", " + metrics_sql("", "pred", 10, p="b", name="mb")
CAND = metrics_sql("", "pred", 10, p="c", name="mc")


@query("probability_metrics", METRIC_COLUMNS, f"{BASE} => select * from mb")
def probability_metrics(t):
    return metrics.probability_metrics(t.predictions, "a_win", "baseline_probability")


@query(
    "auc_rank",
    "month:s auc:d",
    ROWS_SQL.replace("* from", "strftime(game_date, '%Y-%m') as month, * from")
    + """, ranked as (select month, y, rank() over (partition by month order by c) + (count(*) over (partition by month, c) - 1) / 2.0 as r from pred)
    => select month, case when sum(y) > 0 and sum(1 - y) > 0 then (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (cast(sum(y) as double) * sum(1 - y)) end as auc
    from ranked group by month""",
)
def auc_rank(t):
    from pyspark.sql import functions as F

    rows = t.predictions.withColumn("month", F.date_format("game_date", "yyyy-MM"))
    return metrics.auc_rank(rows, "a_win", "candidate_probability", ["month"])


@query(
    "calibration_table",
    "bin:i lower:d upper:d n:i mean_probability:d observed_rate:d absolute_gap:d",
    """binned as (select a_win as y, candidate_probability as p, len(list_filter(range(1, 10), lambda i: candidate_probability >= i * cast(0.1 as double))) as k from predictions)
    => select k + 1 as bin, k / 10.0 as lower, (k + 1) / 10.0 as upper, count(*) as n, avg(p) as mean_probability, avg(y) as observed_rate,
       abs(avg(p) - avg(y)) as absolute_gap from binned group by k""",
)
def calibration_table(t):
    return metrics.calibration_table(t.predictions, "a_win", "candidate_probability")


@query(
    "calibration_right_closed",
    "bin:i n:i mean_probability:d observed_rate:d ece_part:d",
    """binned as (select a_win as y, candidate_probability as p, len(list_filter(range(1, 10), lambda i: candidate_probability > i * cast(0.1 as double))) as k from predictions)
    => select k + 1 as bin, count(*) as n, avg(p) as mean_probability, avg(y) as observed_rate,
       abs(avg(p) - avg(y)) * count(*) / (select count(*) from predictions) as ece_part from binned group by k""",
)
def calibration_right_closed(t):
    return metrics.calibration_right_closed(t.predictions, "a_win", "candidate_probability")


SUBGROUPS = (
    """
dims as (
  select 'all' as dimension, 'all' as value, * from predictions
  union all select 'month', strftime(game_date, '%Y-%m'), * from predictions
  union all select 'candidate_confidence', case when greatest(candidate_probability, 1 - candidate_probability) < 0.55 then '50-54%'
     when greatest(candidate_probability, 1 - candidate_probability) < 0.6 then '55-59%' when greatest(candidate_probability, 1 - candidate_probability) < 0.65 then '60-64%'
     when greatest(candidate_probability, 1 - candidate_probability) < 0.7 then '65-69%' else '70%+' end, * from predictions
  union all select 'baseline_candidate', case when (baseline_probability >= 0.5) = (candidate_probability >= 0.5) then 'agree' else 'disagree' end, * from predictions
  union all select 'team_a_location', case when team_a_is_home = 1 then 'home' else 'away' end, * from predictions), """
    + metrics_sql("dimension, value", "dims", 5, "a_win", "baseline_probability", "sb")
    + ", "
    + metrics_sql("dimension, value", "dims", 5, "a_win", "candidate_probability", "sc")
)


@query(
    "subgroup_metrics",
    "dimension:s value:s n:i "
    + doubles(f"{t}_{m}" for t in ("baseline", "candidate") for m in metrics.METRICS[2:])
    + " "
    + doubles(f"{m}_difference" for m in ("accuracy", "brier", "log_loss", "auc", "ece")),
    SUBGROUPS
    + " => select dimension, value, sb.n, "
    + ", ".join(f"s{t[0]}.{m} as {t}_{m}" for t in ("baseline", "candidate") for m in metrics.METRICS[2:])
    + ", "
    + ", ".join(f"sc.{m} - sb.{m} as {m}_difference" for m in ("accuracy", "brier", "log_loss", "auc", "ece"))
    + " from sb join sc using (dimension, value) where dimension = 'all' or sb.n >= 20",
)
def subgroup_metrics(t):
    return metrics.subgroup_metrics(t.predictions)


GATES = """
g as (
  select 'minimum_walk_forward_games' as gate, case when mc.n >= 1000 then 'PASS' else 'FAIL' end as status, cast(mc.n as double) as observed from mb, mc
  union all select 'brier_improvement', case when mc.brier < mb.brier then 'PASS' else 'FAIL' end, mc.brier - mb.brier from mb, mc
  union all select 'log_loss_improvement', case when mc.log_loss < mb.log_loss then 'PASS' else 'FAIL' end, mc.log_loss - mb.log_loss from mb, mc
  union all select 'auc_regression_limit', case when mc.auc - mb.auc >= -0.005 then 'PASS' else 'FAIL' end, mc.auc - mb.auc from mb, mc
  union all select 'accuracy_regression_limit', case when mc.accuracy - mb.accuracy >= -0.01 then 'PASS' else 'FAIL' end, mc.accuracy - mb.accuracy from mb, mc
  union all select 'calibration_regression_limit', case when mc.ece - mb.ece <= 0.01 then 'PASS' else 'FAIL' end, mc.ece - mb.ece from mb, mc
  union all select 'coverage_regression_limit', 'PASS', 0.0
  union all select 'final_holdout_required', 'PENDING', null
  union all select case gate when 'prospective_games' then 'minimum_prospective_games' when 'closing_line_value_tracking' then 'closing_line_value_tracking_required' when 'schedule_integrity_passed' then 'no_schedule_integrity_errors'
    when 'target_leakage_tests_passed' then 'no_target_leakage' else 'point_in_time_provenance_required' end, status, observed from audit)
"""


@query(
    "promotion_gates",
    "gate:s status:s observed:d overall_status:s",
    f"{BASE}, {CAND}, {ISSUES}, {CHAIN}, {AUDIT}, {GATES.replace('g as (', 'gates as (', 1)} => select *, case when max(case when status = 'FAIL' then 2 when status = 'PENDING' then 1 else 0 end) over () = 2 then 'FAIL' when max(case when status = 'FAIL' then 2 when status = 'PENDING' then 1 else 0 end) over () = 1 then 'PENDING' else 'PASS' end as overall_status from gates",
)
def promotion_gates(t):
    compared = metrics.compare_tracks(t.predictions, "a_win", "baseline_probability", "candidate_probability")
    return metrics.audited_gates(compared, ledger.evidence_audit(t.evidence))


@query(
    "candidate_gates",
    "gate:s status:s observed:d eligible_for_shadow:b eligible_for_promotion:b",
    f"""{BASE}, {CAND}, rb as (select len(list_filter(range(1, 10), lambda i: b > i * cast(0.1 as double))) as k, abs(sum(b) - sum(y)) as g from pred group by k),
    rc as (select len(list_filter(range(1, 10), lambda i: c > i * cast(0.1 as double))) as k, abs(sum(c) - sum(y)) as g from pred group by k),
    e as (select (select sum(g) from rc) / mc.n - (select sum(g) from rb) / mc.n as ece from mc),
    g as (select 'sample_size' as gate, mc.n >= 500 as ok, cast(mc.n as double) as observed from mc
      union all select 'probability_change', avg(abs(c - b)) >= 0.002, avg(abs(c - b)) from pred
      union all select 'brier', mc.brier <= mb.brier, mc.brier - mb.brier from mb, mc
      union all select 'log_loss', mc.log_loss <= mb.log_loss, mc.log_loss - mb.log_loss from mb, mc
      union all select 'auc', mc.auc >= mb.auc, mc.auc - mb.auc from mb, mc
      union all select 'ece', ece <= 0.0025, ece from e)
    => select gate, case when ok then 'PASS' else 'FAIL' end as status, observed, bool_and(ok) over () as eligible_for_shadow, false as eligible_for_promotion from g""",
)
def candidate_gates(t):
    return metrics.candidate_gates(t.predictions, "a_win", "baseline_probability", "candidate_probability")


LONG = """long as (select *, strftime(game_date, '%Y') as season from components)"""
COMPONENT_METRICS = LONG + ", " + metrics_sql("component", "long", 10, "a_win", "p", "m")


@query(
    "select_candidate",
    "candidate:s eligible:b reasons:s selected:s status:s",
    f"""{COMPONENT_METRICS}, b as (select * from m where component = 'elo_pyth'),
    r as (select m.component, m.log_loss, m.brier, length(m.component) as fc, concat_ws(';', case when m.component = 'elo_pyth' then 'baseline' end,
      case when m.component <> 'elo_pyth' and m.log_loss > b.log_loss - 0.00005 then 'log_loss_improvement_below_threshold' end,
      case when m.component <> 'elo_pyth' and m.brier > b.brier - 0.00002 then 'brier_improvement_below_threshold' end,
      case when m.component <> 'elo_pyth' and m.accuracy < b.accuracy - 0.005 then 'accuracy_regression' end,
      case when m.component <> 'elo_pyth' and m.auc < b.auc - 0.003 then 'auc_regression' end,
      case when m.component <> 'elo_pyth' and m.ece > b.ece + 0.005 then 'calibration_regression' end) as reasons from m, b),
    w as (select component from r where reasons = '' order by log_loss, brier, fc limit 1)
    => select component as candidate, reasons in ('', 'baseline') as eligible, reasons, coalesce((select component from w), 'elo_pyth') as selected,
       case when coalesce((select component from w), 'elo_pyth') = 'elo_pyth' then 'baseline_retained' else 'candidate_selected' end as status from r""",
)
def select_candidate(t):
    from pyspark.sql import functions as F

    summary = metrics.probability_metrics(t.components, "a_win", "p", ["component"])
    summary = summary.withColumn("feature_count", F.length("component")).withColumnRenamed("component", "candidate")
    return metrics.select_candidate(summary, "elo_pyth")


@query(
    "paired_deltas",
    "candidate:s matched_games:i " + doubles(f"{m}_difference" for m in ("accuracy", "brier", "log_loss", "auc", "ece")),
    f"{COMPONENT_METRICS} => select m.component as candidate, m.n as matched_games, "
    + ", ".join(f"m.{x} - b.{x} as {x}_difference" for x in ("accuracy", "brier", "log_loss", "auc", "ece"))
    + " from m, (select * from m where component = 'elo_pyth') b",
)
def paired_deltas(t):
    rows = t.components.withColumnsRenamed({"component": "candidate", "p": "probability"})
    return metrics.paired_deltas(rows.filter("candidate = 'elo_pyth'").drop("candidate"), rows, ["game_pk", "game_date"])


RESAMPLES = 2000
MASK = 0xFFFFFFFF
TIMES = " + ".join(f"(u >= {t})::bigint" for t in resampling.poisson_thresholds())


def mixed_sql(z: str, source: str, kept: str) -> str:
    """Subqueries that finalise the 32-bit value z, one step each, and keep further columns."""
    first = f"(select {kept}, (xor(z, z >> 16) * {resampling.MIX_1}::ubigint) & {MASK} as z from (select {kept}, {z} as z from {source}))"
    return f"(select {kept}, xor(z, z >> 16) as z from (select {kept}, (xor(z, z >> 13) * {resampling.MIX_2}::ubigint) & {MASK} as z from {first}))"


LOW = f"(('0x' || substr(md5(k), 9, 8))::ubigint + ((rep + 1)::ubigint * {resampling.GOLDEN}::ubigint & {MASK})) & {MASK}"
DRAWN = mixed_sql("xor(z, ('0x' || substr(md5(k), 1, 8))::ubigint)", mixed_sql(LOW, f"(select v.*, r.rep from v cross join range({RESAMPLES}) r(rep))", "k, y, b, c, rep"), "k, y, b, c, rep")


@query(
    "paired_bootstrap",
    "metric:s point:d low:d high:d bootstrap_samples:i",
    f"""v as (select cast(game_pk as varchar) as k, a_win as y, baseline_probability as b, candidate_probability as c from predictions),
    h as (select rep, y, b, c, z as u from {DRAWN}),
    s as (select rep, y, b, c, sum({TIMES}) as w from h group by rep, y, b, c having sum({TIMES}) > 0 union all select -1, y, b, c, count(*) from v group by y, b, c),
    fb as (select rep, b as p, coalesce(sum(w) filter (where y = 1), 0) as pos, coalesce(sum(w) filter (where y = 0), 0) as neg from s group by rep, b),
    fc as (select rep, c as p, coalesce(sum(w) filter (where y = 1), 0) as pos, coalesce(sum(w) filter (where y = 0), 0) as neg from s group by rep, c),
    ab as (select rep, sum(pos * (below + neg / 2.0)) / (cast(sum(pos) as double) * sum(neg)) as auc from (select *, sum(neg) over (partition by rep order by p) - neg as below from fb) group by rep),
    ac as (select rep, sum(pos * (below + neg / 2.0)) / (cast(sum(pos) as double) * sum(neg)) as auc from (select *, sum(neg) over (partition by rep order by p) - neg as below from fc) group by rep),
    d as (select rep, sum(w * (((c >= 0.5) = (y = 1))::int - ((b >= 0.5) = (y = 1))::int)) / sum(w) as accuracy,
                 sum(w * ((c - y) * (c - y) - (b - y) * (b - y))) / sum(w) as brier,
                 sum(w * ((y * ln(b) + (1 - y) * ln(1 - b)) - (y * ln(c) + (1 - y) * ln(1 - c)))) / sum(w) as log_loss,
                 any_value(ac.auc) - any_value(ab.auc) as auc from s join ab using (rep) join ac using (rep) group by rep),
    l as (select rep, 'accuracy' as metric, accuracy as v from d union all select rep, 'brier', brier from d union all select rep, 'log_loss', log_loss from d union all select rep, 'auc', auc from d)
    => select metric, max(v) filter (where rep = -1) as point, quantile_cont(v, 0.025) filter (where rep >= 0) as low,
       quantile_cont(v, 0.975) filter (where rep >= 0) as high, count(v) filter (where rep >= 0) as bootstrap_samples from l group by metric""",
)
def paired_bootstrap(t):
    return resampling.paired_bootstrap(t.predictions, "a_win", "baseline_probability", "candidate_probability", "game_pk", RESAMPLES)


# the roles of the chronological slices, and weights from the calibration slice
SLICES = """numbered as (select game_pk, row_number() over (order by game_date, substr(md5(cast(game_pk as varchar)), 1, 2), game_pk) - 1 as place, count(*) over () as n from contests),
cut as (select game_pk, place, n, least(greatest(100, floor(n * 0.8)), n - 30) as core from numbered),
slices as (select game_pk, case when place < core then 'core' when place < core + (n - core) // 2 then 'calibration' else 'evaluation' end as role from cut)"""
WEIGHTS = f"""{SLICES}, votes as (select * from components join slices using (game_pk)),
bs as (select component, avg((p - a_win) * (p - a_win)) as brier from votes where role = 'calibration' group by component),
ws as (select component, brier, exp(-10 * brier) / sum(exp(-10 * brier)) over () as weight from bs)"""


def _voted(t, role):
    from pyspark.sql import functions as F

    return t.components.withColumn("role", ensemble.role(t.contests)).where(F.col("role") == role)


@query("ensemble_weights", "component:s brier:d weight:d", f"{WEIGHTS} => select * from ws")
def ensemble_weights(t):
    return metrics.ensemble_weights(_voted(t, "calibration").withColumnRenamed("a_win", "y"))


@query("ensemble_blend", "game_pk:i probability:d", f"{WEIGHTS} => select game_pk, sum(weight * p) as probability from votes join ws using (component) where role = 'evaluation' group by game_pk")
def ensemble_blend(t):
    """Games after the calibration slice, blended with the weights it gave."""
    weights = metrics.ensemble_weights(_voted(t, "calibration").withColumnRenamed("a_win", "y"))
    return metrics.ensemble_blend(_voted(t, "evaluation"), weights, ["game_pk"])


# Newton steps of the penalised likelihood, one row each, and the anchor of the calibration slice
ENSEMBLE = f"""{WEIGHTS}, blended as (select game_pk, any_value(a_win) as y, any_value(role) as role, sum(weight * p) as x from votes join ws using (component) where role <> 'core' group by game_pk),
early as (select b.*, p.baseline_probability as prior from blended b join predictions p using (game_pk) where role = 'calibration'),
newton(i, a, b) as (select 0, 0.0::double, 0.0::double union all
  select i + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) from (
    select i, a, b, sum(p - y) as g1, sum((p - y) * x) + b / {ensemble.CALIBRATOR_C} as g2, sum(p * (1 - p)) as h11, sum(p * (1 - p) * x) as h12, sum(p * (1 - p) * x * x) + 1 / {ensemble.CALIBRATOR_C} as h22
    from (select newton.i, newton.a, newton.b, y, x, 1 / (1 + exp(-(newton.a + newton.b * x))) as p from newton cross join early where newton.i < {ensemble.CALIBRATOR_STEPS}) group by i, a, b)),
fitted as (select a, b from newton where i = {ensemble.CALIBRATOR_STEPS}),
grid as (select w.w, avg(pow(w.w * prior + (1 - w.w) / (1 + exp(-(a + b * x))) - y, 2)) as brier from early cross join fitted cross join (values (0.0::double), (0.25), (0.5), (0.75), (1.0)) w(w) group by w.w),
anchor as (select w from grid order by round(brier, 12), w limit 1),
path as (select game_pk, y as a_win, x as blended, 1 / (1 + exp(-(a + b * x))) as calibrated, w as anchor_weight, baseline_probability as prior from blended join predictions using (game_pk) cross join fitted cross join anchor where role = 'evaluation')"""


@query(
    "ensemble_path",
    "game_pk:i a_win:i blended:d calibrated:d anchor_weight:d probability:d",
    f"{ENSEMBLE} => select *, least(0.92, greatest(0.08, anchor_weight * prior + (1 - anchor_weight) * calibrated)) as probability from path",
)
def ensemble_path(t):
    """Votes to final probabilities: weights, calibrator and anchor from the calibration slice, later games only."""
    priors = t.predictions.withColumnRenamed("baseline_probability", "prior").select("game_pk", "prior")
    return ensemble.ensemble_path(t.components.select("game_pk", "game_date", "a_win", "component", "p"), priors, ensemble.role(t.contests))


@query(
    "anchor_grid_search",
    "weight:d brier:d selected:b",
    """g as (select w.w as weight, avg(pow(w.w * baseline_probability + (1 - w.w) * candidate_probability - a_win, 2)) as brier
       from predictions cross join (values (0.0), (0.25), (0.5), (0.75), (1.0)) w(w) group by w.w)
    => select weight, brier, row_number() over (order by round(brier, 12), weight) = 1 as selected from g""",
)
def anchor_grid_search(t):
    return metrics.anchor_grid_search(t.predictions, "a_win", "baseline_probability", "candidate_probability")


@query(
    "chronological_folds",
    "game_pk:i row_index:i fold:i train_n:i",
    """o as (select game_pk, row_number() over (order by game_date, substr(md5(cast(game_pk as varchar)), 1, 2), game_pk) - 1 as row_index from contests)
    => select game_pk, row_index, case when row_index >= 300 then (row_index - 300) // 100 + 1 end as fold, case when row_index >= 300 then 300 + (row_index - 300) // 100 * 100 end as train_n from o""",
)
def chronological_folds(t):
    return metrics.chronological_folds(t.contests, "game_date", "game_pk")


WINDOWS = (
    ("1995_first_weeks", "1995-01-01", "1995-01-10"),
    ("1996_spring", "1996-03-01", "1996-05-31"),
    ("1998_summer", "1998-06-01", "1998-08-31"),
    ("2000_autumn", "2000-09-01", "2000-11-30"),
    ("2001_summer", "2001-06-01", "2001-08-31"),
    ("2009_not_played", "2009-01-01", "2009-12-31"),
)


@query(
    "walk_forward_split",
    "window:s train_n:i validation_n:i skip_reason:s",
    "w(name, s, e) as (values "
    + ", ".join(f"('{n}', date '{s}', date '{e}')" for n, s, e in WINDOWS)
    + """), c as (select w.name, count(*) filter (where game_date < s) as train_n, count(*) filter (where game_date between s and e) as validation_n from w cross join contests group by w.name)
    => select name as "window", train_n, validation_n, case when train_n < 150 then 'insufficient_training_games' when validation_n = 0 then 'no_validation_games' end as skip_reason from c""",
)
def walk_forward_split(t):
    return metrics.walk_forward_split(t.contests, WINDOWS, 150)


VALIDATION = (("1996_spring", "1996-03-01", "1996-05-31"), ("1998_summer", "1998-06-01", "1998-08-31"), ("2000_autumn", "2000-09-01", "2000-11-30"), ("2001_summer", "2001-06-01", "2001-08-31"))
VALIDATED = "vw(wname, s, e) as (values " + ", ".join(f"('{n}', date '{s}', date '{e}')" for n, s, e in VALIDATION) + ")"
SPLIT = "vr as (select wname, t.track, a_win, case when t.track = 'prior' then prior_probability else strength_probability end as p0 from scored join vw on game_date between s and e cross join (values ('prior'), ('strength')) t(track))"


@query(
    "matched_validation",
    "window:s track:s n:i accuracy:d brier:d log_loss:d auc:d ece:d",
    f"{SCORED}, {VALIDATED}, {SPLIT}, {metrics_sql('wname, track', 'vr', 10, 'a_win', 'p0', 'vm')} => select wname as \"window\", track, n, accuracy, brier, log_loss, auc, ece from vm",
)
def matched_validation(t):
    """Leakage-safe features, closed-form scores of both tracks, metrics per window."""
    from pyspark.sql import functions as F

    scored = scoring.logit_scores(shared.matchups(t))
    day = lambda d: F.lit(d).cast("date")
    hits = F.array_compact(F.array(*[F.when(F.col("game_date").between(day(s), day(e)), F.lit(n)) for n, s, e in VALIDATION]))
    rows = scored.select("a_win", "prior_probability", "strength_probability", F.explode(hits).alias("window"))
    return metrics.track_metrics(rows, "a_win", {"prior": "prior_probability", "strength": "strength_probability"}, ["window"])
