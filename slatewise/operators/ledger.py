"""Prediction ledger: latest events, settlement, integrity and evidence audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import odds
from slatewise.operators.metrics import CLIP, PIPELINE_CLIP, clipped, log_loss

# Event types, outcome-like payload keys, provenance rules
EVENT_TYPES = ("prediction", "closing_line", "outcome")
OUTCOME_KEYS = (
    "a_win", "away_runs", "away_score", "away_won", "final", "final_score", "game_result",
    "home_runs", "home_score", "home_won", "outcome", "result", "winner",
)
REQUIRED_PROVENANCE = ("schedule", "live_feed", "pitcher_stats", "market_input")
PLACEHOLDERS = ("", "missing", "none", "neutral", "neutral_placeholder", "unknown")
SHA256_PATTERN = "^[0-9a-f]{64}$"
SCHEMA_VERSION = 1
SPAN = 4096  # sequences of a ledger that one task looks at
MINIMUM_PROSPECTIVE_GAMES = 500
AUDIT_MINIMUM_GRADED = 100
AUDIT_MINIMUM_FILTERED = 30


def latest_predictions(ledger: DataFrame) -> DataFrame:
    """The last revision of every game's prediction, by one aggregation."""
    rows = ledger.filter("event_type = 'prediction'")
    return rows.groupBy("game_pk").agg(F.max_by(F.struct(*rows.columns), "revision").alias("last")).select("last.*")


def latest_event_join(ledger: DataFrame) -> DataFrame:
    """Latest prediction, outcome and closing line per game in one aggregation.

    Latest means the greatest (recorded_at, sequence).  Games without prediction or outcome drop.
    """
    recency = F.struct("recorded_at", "sequence")
    prediction = [
        "away_team", "home_team", "game_date", "home_probability", "production_home_probability", "home_odds", "away_odds", "offered_home_implied",
        "selection_status", "selection_reasons", "model_version", "candidate_commit", "adaptive_overlay_sha256",
    ]
    latest = lambda kind, value: F.max_by(value, F.when(F.col("event_type") == kind, recency))
    rows = ledger.groupBy("game_pk").agg(
        latest("prediction", F.struct(*[c for c in prediction if c in ledger.columns])).alias("p"),
        latest("outcome", F.col("home_won")).alias("home_won"),
        latest("closing_line", F.col("closing_home_implied")).alias("closing_home_implied"),
    )
    return rows.filter("p is not null and home_won is not null").select("game_pk", "p.*", "home_won", "closing_home_implied")


def settle_predictions(ledger: DataFrame) -> DataFrame:
    """Picks, correctness, scores, ROI at offered odds and signed closing-line value per game.

    ROI is NULL when the picked side has no offered odds.
    """
    rows = latest_event_join(ledger)
    production, shadow, won = F.col("production_home_probability"), F.col("home_probability"), F.col("home_won")
    pick_home = production >= 0.5
    side = lambda home: F.when(home, F.col("home_team")).otherwise(F.col("away_team"))
    correct = pick_home == (won == 1)
    offered = F.when(pick_home, F.col("home_odds")).otherwise(F.col("away_odds"))
    move = F.col("closing_home_implied") - F.col("offered_home_implied")
    return rows.withColumns(
        {
            "production_pick": side(pick_home),
            "shadow_pick": side(shadow >= 0.5),
            "production_correct": correct,
            "shadow_correct": (shadow >= 0.5) == (won == 1),
            "production_brier": F.pow(production - won, 2),
            "shadow_brier": F.pow(shadow - won, 2),
            "production_log_loss": log_loss(won, clipped(production, PIPELINE_CLIP)),
            "shadow_log_loss": log_loss(won, clipped(shadow, PIPELINE_CLIP)),
            "offered_pick_odds": offered,
            "realized_roi": F.when(offered.isNotNull(), F.when(correct, odds.american_to_decimal(offered) - 1.0).otherwise(-1.0)),
            "closing_line_value": F.when(pick_home, move).otherwise(-move),
        }
    )


def settlement_summary(settled: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("correct", "accuracy"))
    n = F.count(F.lit(1))
    return settled.agg(
        F.when(n > 0, "PASS").otherwise("NO_SETTLED_GAMES").alias("status"), n.alias("settled_games"),
        *[rate(f"{t}_{m}") for t in ("production", "shadow") for m in ("correct", "brier", "log_loss")],
        F.avg("realized_roi").alias("recommendation_roi"), F.avg("closing_line_value").alias("average_closing_line_value"),
        F.count_if(F.col("production_pick") != F.col("shadow_pick")).alias("disagreements"),
    )


def forecast_feedback(records: DataFrame) -> DataFrame:
    """Diagnostics over prediction records that may lack outcome or closing price."""
    p, y = clipped(F.col("home_probability"), CLIP), F.col("home_won")
    graded = y.isNotNull()
    value = F.col("closing_home_implied") - F.col("offered_home_implied")
    return records.agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(graded).alias("graded"),
        F.avg(F.when(graded, F.pow(p - y, 2))).alias("brier"), F.avg(F.when(graded, log_loss(y, p))).alias("log_loss"),
        F.avg(F.when(graded, ((p >= 0.5).cast("int") == y).cast("double"))).alias("accuracy"),
        F.avg(value).alias("mean_probability_clv"), F.avg((value > 0).cast("double")).alias("positive_clv_rate"),
    )


def prediction_records(ledger: DataFrame) -> DataFrame:
    """One record per game with a prediction, with the outcome and close where known."""
    recency = F.struct("recorded_at", "sequence")
    latest = lambda kind, value: F.max_by(value, F.when(F.col("event_type") == kind, recency))
    fields = ["home_probability", "production_home_probability", "offered_home_implied"]
    rows = ledger.groupBy("game_pk").agg(
        latest("prediction", F.struct(*fields)).alias("p"), latest("outcome", F.col("home_won")).alias("home_won"),
        latest("closing_line", F.col("closing_home_implied")).alias("closing_home_implied"),
    )
    return rows.filter("p is not null").select("game_pk", "p.*", "home_won", "closing_home_implied")


def track_scorecard(graded: DataFrame, tracks: dict[str, str]) -> DataFrame:
    """Accuracy, Brier and log loss per probability track over rows that carry it."""
    entries = F.array(*[F.struct(F.lit(n).alias("track"), F.col(c).alias("p")) for n, c in tracks.items()])
    rows = graded.select("home_won", F.inline(entries)).filter("p is not null")
    y, p = F.col("home_won"), F.col("p")
    return rows.groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
        F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(log_loss(y, clipped(p, CLIP))).alias("log_loss"),
    )


def cohort_counts(graded: DataFrame) -> DataFrame:
    """Graded games per model version, commit and overlay."""
    name = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    cohort = F.concat_ws("|", name("model_version", "unknown"), name("candidate_commit", "unknown"), name("adaptive_overlay_sha256", "none"))
    return graded.groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("games"))


def _audited(ledger: DataFrame) -> DataFrame:
    """Latest events by sequence (file order), as the abstention audit reads them."""
    latest = lambda kind, value: F.max_by(value, F.when(F.col("event_type") == kind, F.col("sequence")))
    fields = ["away_team", "home_team", "home_probability", "selection_status", "selection_reasons"]
    rows = ledger.groupBy("game_pk").agg(latest("prediction", F.struct(*fields)).alias("p"), latest("outcome", F.col("home_won")).alias("home_won"))
    rows = rows.filter("p is not null and home_won is not null").select("game_pk", "p.*", "home_won")
    status = F.upper(F.coalesce("selection_status", F.lit("UNKNOWN")))
    return rows.withColumns({"raw_correct": (F.col("home_probability") >= 0.5) == (F.col("home_won") == 1), "status": status})


def abstention_audit(ledger: DataFrame, minimum_graded: int = AUDIT_MINIMUM_GRADED, minimum_filtered: int = AUDIT_MINIMUM_FILTERED) -> DataFrame:
    """Did passing on games help?  Only the exact statuses PASS and ELIGIBLE can be judged."""
    filtered, eligible, right = F.col("status") == "PASS", F.col("status") == "ELIGIBLE", F.col("raw_correct")
    sums = _audited(ledger).agg(
        F.count(F.lit(1)).alias("graded_games"), F.count_if(filtered).alias("filtered_games"), F.count_if(eligible).alias("eligible_games"),
        F.count_if(right).alias("raw_wins"), F.count_if(eligible & right).alias("eligible_wins"), F.count_if(filtered & right).alias("false_passes"),
        F.count_if(filtered & ~right).alias("helpful_passes"),
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = sums.withColumn("policy_evaluable_games", F.col("filtered_games") + F.col("eligible_games"))
    out = out.withColumns(
        {
            "unclassifiable_games": F.col("graded_games") - F.col("policy_evaluable_games"),
            "raw_accuracy": share("raw_wins", "graded_games"),
            "eligible_accuracy": share("eligible_wins", "eligible_games"),
            "filtered_raw_accuracy": share("false_passes", "filtered_games"),
            "helpful_pass_rate": share("helpful_passes", "filtered_games"),
            "coverage": share("eligible_games", "policy_evaluable_games"),
            "overall_recommendation_coverage": share("eligible_games", "graded_games"),
            "graded_games_remaining": F.greatest(F.lit(0), minimum_graded - F.col("policy_evaluable_games")),
            "filtered_games_remaining": F.greatest(F.lit(0), minimum_filtered - F.col("filtered_games")),
        }
    )
    ready = (F.col("graded_games_remaining") == 0) & (F.col("filtered_games_remaining") == 0)
    return out.withColumns(
        {"accuracy_lift": F.col("eligible_accuracy") - F.col("raw_accuracy"), "evidence_status": F.when(ready, "READY_FOR_REVIEW").otherwise("PENDING")}
    )


def abstention_by_reason(ledger: DataFrame) -> DataFrame:
    """Raw record of the games each reason token touched."""
    tokens = F.array_distinct(F.filter(F.split(F.coalesce("selection_reasons", F.lit("")), ";"), lambda r: r != ""))
    rows = _audited(ledger).select("raw_correct", F.explode(tokens).alias("reason"))
    out = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("raw_correct")).alias("raw_wins"))
    return out.withColumns({"raw_losses": F.col("games") - F.col("raw_wins"), "helpful_pass_rate": (F.col("games") - F.col("raw_wins")) / F.col("games")})


def event_content() -> Column:
    """The canonical text of a whole event, which its digest covers, without the link to its predecessor."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    fields = ("schema_version", "sequence", "event_type", "game_pk", "recorded_at", "scheduled_start", "source", "snapshot_sha256", "provenance", "payload")
    return F.concat_ws("|", *[known(c) for c in fields])


def hash_chain_verify(events: DataFrame, content: Column | None = None) -> DataFrame:
    """Per ledger stream: is the chain intact, and where and how does it first break.

    Events meet their predecessors within spans of ``SPAN`` sequences, so one long ledger spreads over the cluster instead of being
    walked in order by a single task; the last events of a span go to the next one, too.  A sequence that occurs twice is a
    break, also at the end of the ledger (a fork).  Digests are checked where the events are read and do not travel; events that lie by
    stream already are not moved at all.
    """
    content = event_content() if content is None else content
    digest = F.sha2(F.concat(content, F.lit("|"), F.coalesce("previous_event_sha256", F.lit(""))), 256)
    late = (
        F.when(F.col("event_sha256") != digest, "hash_mismatch")
        .when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "unsupported_schema")
        .when(~F.col("event_type").isin(*EVENT_TYPES), "unknown_event_type")
    )
    span, place = F.floor(F.col("sequence") / SPAN), F.col("sequence")
    spans = F.when((place + 1) % SPAN == 0, F.array(span, span + 1)).otherwise(F.array(span))
    rows = events.select("stream", "sequence", "previous_event_sha256", "event_sha256", late.alias("late"), F.explode(spans).alias("span"))
    linked = F.min("event_sha256").over(Window.partitionBy("stream", "span").orderBy("sequence").rangeBetween(-1, -1))
    own = rows.withColumn("linked", linked).where(F.col("span") == span)
    copies = own.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("stream", "span", "sequence")))
    first = place == 1
    early = (
        F.when(F.col("copies") > 1, "repeated_sequence")
        .when(~first & F.col("linked").isNull(), "sequence_gap")
        .when(first & F.col("previous_event_sha256").isNotNull(), "broken_chain")
        .when(~first & ~F.col("previous_event_sha256").eqNullSafe(F.col("linked")), "broken_chain")
    )
    known = copies.select("stream", "sequence", "event_sha256", early.alias("early"), "late").where("stream is not null and event_sha256 is not null")
    marked = known.withColumn("first_use", F.min("sequence").over(Window.partitionBy("stream", "event_sha256")))
    problem = F.coalesce("early", F.when(F.col("first_use") < place, "duplicate_hash"), "late")
    marked = marked.withColumn("problem", problem)
    at = F.when(F.col("problem").isNotNull(), F.col("sequence"))
    out = marked.groupBy("stream").agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first_break"), F.min_by("problem", at).alias("problem"))
    return out.withColumn("status", F.when(F.col("first_break").isNull(), "PASS").otherwise("FAIL"))


def forbidden_key(payload: Column) -> Column:
    """The first outcome-like key anywhere in a JSON text, NULL when there is none."""
    keys = F.regexp_extract_all(payload, F.lit(r'"\s*([^"\\]*?)\s*"\s*:'), F.lit(1))
    found = F.filter(keys, lambda k: F.lower(k).isin(*OUTCOME_KEYS))
    return F.try_element_at(found, F.lit(1))


def leakage_key_scan(events: DataFrame) -> DataFrame:
    """Every prediction with the outcome-like key its payload carries, if any."""
    rows = events.filter(F.col("event_type") == "prediction")
    return rows.select("stream", "sequence", forbidden_key(F.col("payload")).alias("forbidden_key"))


def event_payload_validate(events: DataFrame) -> DataFrame:
    """First broken payload, timing or hash rule per event in ``reason``."""
    number = lambda k: F.get_json_object("payload", f"$.{k}").try_cast("double")
    text = lambda k: F.coalesce(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    not_probability = lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    home, away, close, won = (number(k) for k in ("home_probability", "away_probability", "closing_home_implied", "home_won"))
    kind = F.col("event_type")
    is_prediction = kind == "prediction"
    reason = (
        F.when(~kind.isin(*EVENT_TYPES), "unknown_event_type")
        .when(F.col("game_pk") <= 0, "game_pk_not_positive")
        .when(F.trim("source") == "", "source_required")
        .when(kind.isin("prediction", "closing_line") & (F.col("recorded_at") > F.col("scheduled_start")), "recorded_after_start")
        .when((kind == "outcome") & (F.col("recorded_at") < F.col("scheduled_start")), "outcome_before_start")
        .when(is_prediction & forbidden_key(F.col("payload")).isNotNull(), "outcome_like_field")
        .when(is_prediction & ((text("away_team") == "") | (text("home_team") == "") | (text("home_probability") == "") | (text("model_version") == "")), "missing_field")
        .when(is_prediction & not_probability(home), "invalid_probability")
        .when(is_prediction & (text("away_probability") != "") & not_probability(away), "invalid_probability")
        .when(is_prediction & (F.abs(home + away - 1.0) > 1e-6), "probabilities_do_not_sum")
        .when((kind == "closing_line") & not_probability(close), "invalid_closing_line")
        .when((kind == "outcome") & (won.isNull() | ~won.isin(0.0, 1.0)), "outcome_not_binary")
        .when(F.col("snapshot_sha256").isNotNull() & ~F.col("snapshot_sha256").rlike(SHA256_PATTERN), "invalid_snapshot_hash")
    )
    return events.select("stream", "sequence", "event_type", reason.alias("reason"))


def evidence_issues(events: DataFrame) -> DataFrame:
    """Every audit issue as (category, game_pk, sequence, detail).

    Rules on single events come from one scan that emits an array of issues per event; rules
    on a whole game come from one aggregation.
    """
    kind, text = F.col("event_type"), lambda k: F.get_json_object("payload", f"$.{k}")
    is_prediction = kind == "prediction"
    issue = lambda condition, category, detail: F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(detail).alias("detail")))
    provenance = F.from_json("provenance", "map<string,string>")
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_PROVENANCE]), F.map_keys(provenance))) > 0
    placeholder = (F.size(provenance) == 0) | F.exists(F.map_values(provenance), lambda v: F.lower(F.trim(v)).isin(*PLACEHOLDERS))
    bad_hash = lambda c: c.isNull() | ~c.rlike(SHA256_PATTERN)
    starter = []
    for side in ("away", "home"):
        person, digest = text(f"{side}_starter_id"), text(f"{side}_starter_snapshot_sha256")
        number = person.try_cast("long")
        starter += [
            issue(is_prediction & person.isNotNull() & (number.isNull() | (number <= 0)), "provenance", f"invalid {side} starter id"),
            issue(is_prediction & person.isNotNull() & bad_hash(digest), "provenance", f"{side} starter without snapshot hash"),
            issue(is_prediction & person.isNull() & digest.isNotNull(), "provenance", f"{side} starter snapshot without id"),
        ]
    per_event = events.select(
        "game_pk", "sequence",
        F.array_compact(
            F.array(
                issue(kind.isin("prediction", "closing_line") & (F.col("recorded_at") > F.col("scheduled_start")), "schedule_integrity", "recorded after start"),
                issue((kind == "outcome") & (F.col("recorded_at") < F.col("scheduled_start")), "schedule_integrity", "outcome before start"),
                issue(is_prediction & forbidden_key(F.col("payload")).isNotNull(), "target_leakage", "outcome-like field"),
                issue(is_prediction & bad_hash(F.col("snapshot_sha256")), "provenance", "no valid snapshot hash"),
                issue(is_prediction & missing, "provenance", "missing provenance keys"),
                issue(is_prediction & placeholder, "provenance", "placeholder provenance values"),
                *starter,
            )
        ).alias("issues"),
    ).select("game_pk", "sequence", F.inline("issues"))
    teams = F.when(is_prediction, F.concat_ws("|", text("away_team"), text("home_team")))
    won = F.when(kind == "outcome", text("home_won"))
    differs = lambda c: F.min(c) != F.max(c)
    games = events.groupBy("game_pk").agg(
        F.array_compact(
            F.array(
                issue(differs(F.col("scheduled_start")), "schedule_integrity", "conflicting scheduled start"),
                issue(differs(teams), "schedule_integrity", "conflicting teams"),
                issue(differs(won), "schedule_integrity", "conflicting outcomes"),
            )
        ).alias("issues")
    )
    per_game = games.select("game_pk", F.lit(None).cast("long").alias("sequence"), F.inline("issues"))
    return per_event.withColumn("sequence", F.col("sequence").cast("long")).unionByName(per_game)


def evidence_audit(events: DataFrame, minimum_games: int = MINIMUM_PROSPECTIVE_GAMES) -> DataFrame:
    """The five evidence gates with what was observed.

    Games and issues reduce to one row each before they meet.
    """
    kind = F.col("event_type")
    games = events.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "prediction").alias("p"), F.count_if(kind == "outcome").alias("o"), F.count_if(kind == "closing_line").alias("c")
    )
    graded = (F.col("p") > 0) & (F.col("o") > 0)
    seen = games.agg(
        F.sum("n").alias("events"), F.sum("p").alias("predictions"), F.count_if(graded).alias("graded"), F.count_if(graded & (F.col("c") > 0)).alias("closed")
    ).withColumn("_one", F.lit(1))
    of = lambda category: F.count_if(F.col("category") == category)
    chain = hash_chain_verify(events).agg(F.count_if(F.col("status") == "FAIL").alias("broken")).withColumn("_one", F.lit(1))
    issues = evidence_issues(events).agg(of("schedule_integrity").alias("schedule"), of("target_leakage").alias("leakage"), of("provenance").alias("provenance"))
    row = seen.join(issues.withColumn("_one", F.lit(1)), "_one").join(chain, "_one")
    intact = F.col("broken") == 0
    gate = lambda name, status, observed: F.struct(F.lit(name).alias("gate"), status.alias("status"), observed.cast("long").alias("observed"))
    clean = lambda issue, needed: F.when(needed == 0, "PENDING").when(intact & (F.col(issue) == 0), "PASS").otherwise("FAIL")
    return row.select(
        F.inline(
            F.array(
                gate("prospective_games", F.when(~intact, "FAIL").when(F.col("graded") >= minimum_games, "PASS").otherwise("PENDING"), F.col("graded")),
                gate("closing_line_value_tracking", F.when(~intact, "FAIL").when(F.col("graded") == 0, "PENDING").when(F.col("closed") == F.col("graded"), "PASS").otherwise("FAIL"), F.col("closed")),
                gate("schedule_integrity_passed", clean("schedule", F.col("events")), F.col("schedule")),
                gate("target_leakage_tests_passed", clean("leakage", F.col("predictions")), F.col("leakage")),
                gate("point_in_time_provenance", clean("provenance", F.col("predictions")), F.col("provenance")),
            )
        )
    )
