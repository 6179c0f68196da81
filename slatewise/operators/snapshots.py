"""Audits of immutable starter captures and the overlay training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions.season_lines import once, starter_k_rate
from slatewise.operators.context import CONTEXT_FEATURES
from slatewise.operators.ledger import latest_event_join
from slatewise.operators.metrics import CLIP, clipped

# Envelope kind, sides and the tolerance of recomputed metrics
STARTER_KIND = "starter_stats"
SIDES = ("away", "home")
TOLERANCE = 1e-10


def starter_snapshot_issues(captures: DataFrame) -> DataFrame:
    """Every broken rule per capture: kind, identity text, time, raw hash, recomputed metric.  Each payload is parsed once."""
    expected = F.concat_ws(":", F.col("game_pk").cast("string"), "side", F.col("pitcher_id").cast("string"))
    issue = lambda bad, category: F.when(bad, category)

    def found(metric: Column) -> Column:
        scale = F.greatest(F.lit(1.0), F.abs(metric))
        return F.array_compact(
            F.array(
                issue(F.col("kind") != STARTER_KIND, "kind"),
                issue(F.col("captured_at") > F.col("scheduled_start"), "post_start"),
                issue(~F.col("side").isin(*SIDES), "side"),
                issue(F.col("identity") != expected, "identity"),
                issue(F.sha2("raw_payload", 256) != F.col("raw_payload_sha256"), "raw_hash"),
                issue(metric.isNull() != F.col("starter_k_rate").isNull(), "metric"),
                issue(F.abs(metric - F.col("starter_k_rate")) > TOLERANCE * scale, "metric"),
            )
        )

    return captures.withColumn("issues", once(starter_k_rate(F.col("raw_payload")), found))


def starter_snapshot_audit(captures: DataFrame) -> DataFrame:
    """One row: captures, valid ones, issue counts per category, games by completeness, status."""
    checked = starter_snapshot_issues(captures)
    categories = ("kind", "post_start", "side", "identity", "raw_hash", "metric")
    valid = F.size("issues") == 0
    per_game = checked.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("ok"), *[F.count_if(F.array_contains("issues", c)).alias(c) for c in categories],
        *[F.max((valid & (F.col("side") == s)).cast("int")).alias(s) for s in SIDES],
    )
    both = F.col("away") + F.col("home")
    out = per_game.agg(
        F.sum("n").alias("snapshots"), F.sum("ok").alias("valid_snapshots"), F.count_if(both == 2).alias("complete_games"), F.count_if(both == 1).alias("partial_games"),
        *[F.sum(c).alias(f"{c}_issues") for c in categories],
    )
    total = sum((F.col(f"{c}_issues") for c in categories), F.lit(0))
    return out.withColumn("status", F.when(F.col("snapshots").isNull(), "PENDING").when(total > 0, "FAIL").otherwise("PASS"))


def overlay_training_frame(ledger: DataFrame, payloads: DataFrame) -> DataFrame:
    """Graded predictions with the base logit and the 16 context features of their payload.

    ``payloads``: game_pk and the JSON object of home-oriented features; absent ones are zero.
    """
    rows = latest_event_join(ledger).select("game_pk", "game_date", F.col("home_probability").alias("base_home_probability"), "home_won")
    # numbers are joined, not texts, and never broadcast: Spark plans a text at 20 bytes, a payload takes some 500
    values = F.from_json("context_features", "map<string,double>")
    features = [F.coalesce(F.try_element_at(values, F.lit(c)), F.lit(0.0)).alias(c) for c in CONTEXT_FEATURES]
    rows = rows.filter("base_home_probability > 0 and base_home_probability < 1").join(payloads.select("game_pk", *features).hint("merge"), "game_pk")
    p = clipped(F.col("base_home_probability"), CLIP)
    return rows.select("game_pk", "game_date", "base_home_probability", "home_won", F.log(p / (1.0 - p)).alias("base_home_logit"), *CONTEXT_FEATURES)
