"""Feature contracts, missingness, catalog, authority and sensitivity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.functions.names import LIVE_FEATURES, TEAM_ALIASES, feature_group, feature_group_of, normalise_name
from slatewise.operators.positions import running_before

# Contract families and authority thresholds
BASELINE_EXCLUDED = (
    "win3_diff", "rf3_diff", "rf3_sum", "ra3_diff", "ra3_sum", "rd3_diff",
    "form_win_momentum_diff", "form_rf_momentum_diff", "form_ra_momentum_diff", "form_rd_momentum_diff",
)
WINDOW_PATTERN = re.compile(r"^(?:opp_adj_)?(?:win|rf|ra|rd)(\d+)(?:_|$)")
MINIMUM_OBSERVATIONS = 100
SCORE_PROXIES = ("weather_run_factor", "park_run_factor")
OVERLAY_RELATED = ("starter_fip", "starter_k_minus_bb", "bullpen_fatigue", "closer_available", "travel_fatigue", "injury_war", "lineup_confirmed")
MODEL_ORDER = ("logistic", "random_forest", "neural_network", "xgboost", "lightgbm", "catboost", "elo_pyth")
GROUP_ORDER = (
    "team_strength", "offense", "run_prevention", "recent_form", "starting_pitcher", "bullpen", "lineup", "injuries",
    "defense", "baserunning", "rest_and_travel", "home_field", "park_and_umpire", "weather", "market",
)


def missingness_pairs(rows: DataFrame, names: Sequence[str] = LIVE_FEATURES) -> DataFrame:
    """live_<f> (0 when unknown) and missing_<f> for each input, from <f>_diff or <f>."""
    out = []
    for name in names:
        known = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in (f"{name}_diff", name) if c in rows.columns]
        value = F.coalesce(*known) if known else F.lit(None).cast("double")
        out += [F.coalesce(value, F.lit(0.0)).alias(f"live_{name}"), value.isNull().cast("double").alias(f"missing_{name}")]
    kept = [c for c in rows.columns if c in ("game_pk", "game_date", "a_win")]
    return rows.select(*kept, *out)


def contract_columns(columns: Sequence[str], windows: Sequence[int], momentum: bool = True, ewm: bool = True, last_game: bool = True, adjusted: bool = False) -> list[str]:
    """The columns one explicit recent-form contract keeps."""

    def kept(column: str) -> bool:
        if column.startswith("opp_adj_"):
            window = WINDOW_PATTERN.match(column)
            return adjusted and (momentum if window is None else int(window[1]) in windows)
        if column.startswith("last_"):
            return last_game
        if column.startswith("ewm_"):
            return ewm
        if column.startswith("form_"):
            return momentum
        window = WINDOW_PATTERN.match(column)
        return window is None or int(window[1]) in windows

    return [c for c in columns if kept(c)]


def feature_contract_project(features: DataFrame, **contract) -> DataFrame:
    return features.select(*contract_columns(features.columns, **contract))


def baseline_contract(features: DataFrame) -> DataFrame:
    return features.drop(*BASELINE_EXCLUDED)


def feature_catalog(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every feature's group, observed rows and mean, in one pass over the rows.

    A repeated or unknown name fails before any job runs.
    """
    if len(set(names)) != len(names):
        raise ValueError("repeated feature name")
    for name in names:
        feature_group_of(name)
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("observed_rows"), F.avg(c).alias("mean"))
    rows = features.agg(F.array(*[entry(c) for c in names]).alias("f")).select(F.inline("f"))
    return rows.withColumn("feature_group", feature_group(F.col("feature")))


def feature_authority(rows: DataFrame, names: Sequence[str] = LIVE_FEATURES) -> DataFrame:
    """Which live inputs history supports, from live_/missing_ pairs.

    Observed values collapse to (feature, value) counts before distinct counts.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"live_{n}").alias("value"), F.col(f"missing_{n}").alias("missing")) for n in names])
    long = rows.select(F.inline(pairs))
    values = long.groupBy("feature", F.when(F.col("missing") < 0.5, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("value").isNotNull()
    n = F.when(seen, F.col("n")).otherwise(0)
    stats = values.groupBy("feature").agg(
        F.sum("n").alias("historical_rows"), F.sum(n).alias("observed_rows"), F.count_if(seen).alias("unique_values")
    )
    # merged by count, mean and squared deviations, so large values cancel nothing
    spread = long.groupBy("feature").agg(F.var_pop(F.when(F.col("missing") < 0.5, F.col("value"))).alias("spread"))
    out = stats.join(spread, "feature").withColumns({"coverage": F.col("observed_rows") / F.col("historical_rows"), "variance": F.when(F.col("observed_rows") >= 2, F.col("spread"))})
    trained = (F.col("observed_rows") >= MINIMUM_OBSERVATIONS) & (F.col("unique_values") >= 2) & (F.coalesce("variance", F.lit(0.0)) > 0)
    status = (
        F.when(trained, "ACTIVE_TRAINED")
        .when(F.col("feature").isin(*SCORE_PROXIES), "ACTIVE_DIRECT_PROXY")
        .when(F.col("feature").isin(*OVERLAY_RELATED), "CAPTURED_PENDING_ADAPTIVE_AUTHORITY")
        .otherwise("CAPTURE_ONLY")
    )
    out = out.withColumns({"feature_group": feature_group(F.concat(F.lit("live_"), F.col("feature"))), "status": status})
    same = Window.partitionBy("status")  # one row per live input
    return out.withColumn("status_count", F.count(F.lit(1)).over(same)).drop("spread")


def exact_medians(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column as (feature, median).

    Values collapse to counts per distinct value; running counts over sampled ranges then find the
    middle, so no column is held or sorted by one task, whatever outliers it has.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = rows.select(F.inline(entries)).filter("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(counts.groupBy("feature").agg(F.sum("n").alias("total")), "feature")
    ranked = running_before(joined, ["feature"], [F.col("value")], {"n": "below"})
    covers = lambda place: (F.col("below") < place) & (F.col("below") + F.col("n") >= place)
    first, second = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return ranked.groupBy("feature").agg(
        ((F.max(F.when(covers(first), F.col("value"))) + F.max(F.when(covers(second), F.col("value")))) / 2).alias("median")
    )


def group_sensitivity(features: DataFrame, score, columns: Sequence[str]) -> DataFrame:
    """Probability minus probability with one feature group at its medians, for each group.

    ``score`` maps a column lookup to a probability Column.  Medians are a handful of scalars;
    every group is a further projection of the same row, so nothing is repeated or joined.
    """
    medians = {r["feature"]: r["median"] for r in exact_medians(features, columns).collect()}  # one value per feature
    groups: dict[str, set[str]] = {}
    for c in columns:
        groups.setdefault(feature_group_of(c), set()).add(c)
    base = score(F.col)
    effects = {g: base - score(lambda c, g=g: F.lit(medians[c]) if c in groups[g] else F.col(c)) for g in groups}
    out = features.select("game_pk", base.alias("probability"), *[e.alias(f"sensitivity_{g}") for g, e in effects.items()])
    sign = F.when(F.col("probability") >= 0.5, 1.0).otherwise(-1.0)
    ordered = [g for g in GROUP_ORDER if g in groups]  # equal effects resolve to the first group
    effect = lambda g: F.round(sign * F.col(f"sensitivity_{g}"), 12).alias("effect")
    ranked = lambda step: F.array(*[F.struct(effect(g), F.lit(step * i).alias("place"), F.lit(g).alias("name")) for i, g in enumerate(ordered)])
    top, bottom = F.array_max(ranked(-1)), F.array_min(ranked(1))
    return out.withColumns({"top_supporting_group": F.when(top["effect"] > 0, top["name"]), "top_opposing_group": F.when(bottom["effect"] < 0, bottom["name"])})


def registry_check(components: DataFrame) -> DataFrame:
    """Does every contest carry exactly the seven named components once each."""
    known = F.col("component").isin(*MODEL_ORDER)
    per_game = components.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("unexpected"), *[F.count_if(F.col("component") == m).alias(f"_{m}") for m in MODEL_ORDER]
    )
    missing = sum((F.when(F.col(f"_{m}") == 0, 1).otherwise(0) for m in MODEL_ORDER), F.lit(0))
    rows = per_game.select("n", "unexpected", missing.alias("missing"))
    good = (F.col("n") == len(MODEL_ORDER)) & (F.col("unexpected") == 0) & (F.col("missing") == 0)
    return rows.agg(F.count(F.lit(1)).alias("games"), F.count_if(good).alias("complete"), F.sum("missing").alias("missing"), F.sum("unexpected").alias("unexpected"))


def club_aliases(spark: SparkSession) -> DataFrame:
    """The fixed club spellings as an alias table."""
    return spark.createDataFrame(list(TEAM_ALIASES.items()), "alias string, code string")


def team_name_normalise(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Club code of a typed name by alias, else by the code itself; NULL when neither is known.

    ``aliases``: alias (normalised), code.  There is one row per known spelling.
    """
    table = aliases.select(F.col("alias").alias("normalised"), F.col("code").alias("by_alias"))
    codes = aliases.select(F.col("code").alias("typed_code"), F.lit(True).alias("is_code")).distinct()
    keyed = rows.withColumns({"normalised": normalise_name(F.col(name)), "typed_code": F.upper(F.trim(name))})
    joined = keyed.join(table, "normalised", "left").join(codes, "typed_code", "left")
    code: Column = F.coalesce("by_alias", F.when(F.col("is_code"), F.col("typed_code")))
    return joined.select(*rows.columns, "normalised", code.alias("team_code"))
