"""Plate-appearance events: classification, priors, transitions, profiles and matchups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.season_lines import first_stat, number

# Event order, flag priority, prior strengths and exponents
EVENTS = ("K", "BB", "HBP", "1B", "2B", "3B", "HR", "REACH", "OUT")
EVENT_FLAGS = (
    ("REACH", ("k_safe", "roe", "fc", "xi")),
    ("K", ("k",)),
    ("BB", ("walk",)),
    ("HBP", ("hbp",)),
    ("1B", ("single",)),
    ("2B", ("double",)),
    ("3B", ("triple",)),
    ("HR", ("hr",)),
    ("OUT", ("othout", "sh", "sf")),
)
BATTER_PRIOR, STARTER_PRIOR, BULLPEN_PRIOR = 60.0, 90.0, 240.0
RATE_EXPONENT = 0.5
PRIOR_FLOOR = 1e-9
HOME_NON_OUT = 1.04
DEFAULT_HIT_MIX = (0.75, 0.23, 0.02)


def pa_event_classify(rows: DataFrame) -> DataFrame:
    """Event and base masks of each plate appearance; unmapped rows and bad outs carry an error."""
    flag = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0.0
    event = F.lit(None).cast("string")
    for name, flags in reversed(EVENT_FLAGS):
        hit = flag(flags[0])
        for f in flags[1:]:
            hit = hit | flag(f)
        event = F.when(hit, name).otherwise(event)
    mask = lambda suffix: sum((F.when(F.col(f"br{i}_{suffix}").isNotNull(), 2 ** (i - 1)).otherwise(0) for i in (1, 2, 3)), F.lit(0))
    bad_outs = ~F.col("outs_pre").isin(0, 1, 2) | (F.col("outs_post") < F.col("outs_pre")) | (F.col("outs_post") > 3)
    out = rows.withColumns({"event": event, "base_pre": mask("pre"), "base_post": mask("post"), "outs_added": F.col("outs_post") - F.col("outs_pre")})
    return out.withColumn("error", F.when(F.col("event").isNull(), "unmapped_event").when(bad_outs, "invalid_outs"))


def event_rate_prior(plays: DataFrame) -> DataFrame:
    """Count and share of each event."""
    counts = plays.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # one row per event


OUTCOME = ["outs_added", "base_post", "runs"]


def transition_distribution(plays: DataFrame) -> DataFrame:
    """P(outs added, bases after, runs | outs, bases, event).

    Plays collapse to counts first; the share is taken over the collapsed rows.
    """
    counts = plays.groupBy("outs_pre", "base_pre", "event", *OUTCOME).agg(F.count(F.lit(1)).alias("n"))
    state = Window.partitionBy("outs_pre", "base_pre", "event")
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(state))


def transition_grid_fill(plays: DataFrame) -> DataFrame:
    """The full 3 x 8 x 9 state grid; states never seen take the event's overall distribution."""
    spark = plays.sparkSession
    cells = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("outs_pre")
    grid = spark.range(1).select(cells).select("outs_pre", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("base_pre"))
    grid = grid.select("outs_pre", "base_pre", F.explode(F.array(*[F.lit(e) for e in EVENTS])).alias("event"))
    exact = transition_distribution(plays)
    keys = ["outs_pre", "base_pre", "event"]
    overall = plays.groupBy("event", *OUTCOME).agg(F.count(F.lit(1)).alias("n"))
    overall = overall.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("event")))
    seen = grid.join(exact, keys).withColumn("source", F.lit("exact"))
    unseen = grid.join(exact.select(*keys).distinct(), keys, "left_anti").join(overall, "event").withColumn("source", F.lit("event"))
    return seen.unionByName(unseen)


def prior_vector(prior: DataFrame, floor: float = 0.0) -> DataFrame:
    """Event probabilities as one array in event order; events never seen count zero.

    A positive ``floor`` lifts small values and renormalises.
    """
    vector = prior.agg(F.array(*[F.coalesce(F.sum(F.when(F.col("event") == e, F.col("probability"))), F.lit(0.0)) for e in EVENTS]).alias("prior"))
    if floor > 0:
        vector = vector.select(F.transform("prior", lambda p: F.greatest(F.lit(floor), p)).alias("prior")).select(normalised(F.col("prior")).alias("prior"))
    return vector


def _with_prior(rows: DataFrame, prior: DataFrame, floor: float = 0.0) -> DataFrame:
    one = F.lit(1)  # the prior is a single row
    return rows.withColumn("_one", one).join(prior_vector(prior, floor).withColumn("_one", one), "_one").drop("_one")


def _at(event: str) -> Column:
    return F.col("prior")[EVENTS.index(event)]


def event_profile_counts(seasons: DataFrame, prior: DataFrame, kind: str) -> DataFrame:
    """Season lines as nine event counts in event order plus opportunities.

    Hitters: singles are the hits left over.  Pitchers: hits that stayed in the park split by the
    prior's mix.  The rest splits between reaching and outs by the prior.
    """
    stat = first_stat(F.col("payload"))
    get = lambda k: F.coalesce(number(stat, k), F.lit(0.0))
    rows = _with_prior(seasons, prior)
    if kind == "hitter":
        total, walks, hbp, so, hits, homers = (get(k) for k in ("plateAppearances", "baseOnBalls", "hitByPitch", "strikeOuts", "hits", "homeRuns"))
        doubles, triples = get("doubles"), get("triples")
        singles = F.greatest(F.lit(0.0), hits - doubles - triples - homers)
        known = so + walks + hbp + singles + doubles + triples + homers
    else:
        total, walks, hbp, so, hits, homers = (get(k) for k in ("battersFaced", "baseOnBalls", "hitBatsmen", "strikeOuts", "hits", "homeRuns"))
        in_park, mix = F.greatest(F.lit(0.0), hits - homers), _at("1B") + _at("2B") + _at("3B")
        share = lambda e, default: F.when(mix > 0, _at(e) / F.nullif(mix, F.lit(0.0))).otherwise(default)
        singles, doubles, triples = (in_park * share(e, d) for e, d in zip(("1B", "2B", "3B"), DEFAULT_HIT_MIX, strict=True))
        known = so + walks + hbp + hits
    rest, both = F.greatest(F.lit(0.0), total - known), _at("REACH") + _at("OUT")
    reach = F.when(both > 0, rest * _at("REACH") / F.nullif(both, F.lit(0.0))).otherwise(0.0)
    counts = F.array(so, walks, hbp, singles, doubles, triples, homers, reach, rest - reach)
    key = "player_id" if kind == "hitter" else "pitcher_id"
    return rows.select(key, counts.alias("counts"), total.alias("opportunities"))


def profile_combine(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of profiles per key, as nine plain sums."""
    sums = [F.coalesce(F.sum(F.col("counts")[i]), F.lit(0.0)) for i in range(len(EVENTS))]
    return profiles.groupBy(*keys).agg(F.array(*sums).alias("counts"), F.sum("opportunities").alias("opportunities"))


def normalised(values: Column) -> Column:
    return F.transform(values, lambda v: v / F.aggregate(values, F.lit(0.0), lambda a, b: a + b))


def posterior_rates(profiles: DataFrame, prior: DataFrame, strength: float) -> DataFrame:
    """(counts + k * prior) / (n + k), floored and normalised."""
    rows = profiles if "prior" in profiles.columns else _with_prior(profiles, prior)
    weight = F.col("opportunities") + strength
    raw = F.zip_with("counts", "prior", lambda c, p: F.greatest(F.lit(1e-12), (c + strength * p) / weight))
    return rows.withColumn("raw", F.when(weight > 0, raw).otherwise(F.col("prior"))).withColumn("rates", normalised(F.col("raw"))).drop("raw")


def batter_pitcher_matchup(batters: DataFrame, pitchers: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """Event probabilities of each lineup slot against the starter and the bullpen it meets.

    ``batters``: keys, player_id, batting_home, counts, opportunities.  ``pitchers``: keys, role
    (starter or bullpen), counts, opportunities; a key holds one row per role.
    """
    batters, pitchers = _with_prior(batters, prior, PRIOR_FLOOR), _with_prior(pitchers, prior, PRIOR_FLOOR)
    b = posterior_rates(batters, prior, BATTER_PRIOR).select(*keys, "player_id", "batting_home", "prior", F.col("rates").alias("batter"))
    s = posterior_rates(pitchers.filter("role = 'starter'"), prior, STARTER_PRIOR)
    p = s.unionByName(posterior_rates(pitchers.filter("role = 'bullpen'"), prior, BULLPEN_PRIOR)).select(*keys, "role", F.col("rates").alias("pitcher"))
    rows = b.join(p, keys)
    lift = lambda rate, base: F.pow(F.least(F.lit(1e6), F.greatest(F.lit(1e-6), rate / base)), F.lit(RATE_EXPONENT))
    scaled = F.zip_with(F.zip_with("batter", "prior", lambda r, base: base * lift(r, base)), F.zip_with("pitcher", "prior", lift), lambda x, y: x * y)
    home = F.array(*[F.lit(1.0 if e in ("K", "OUT") else HOME_NON_OUT) for e in EVENTS])
    scaled = F.zip_with(scaled, home, lambda v, h: F.greatest(F.lit(1e-12), F.when(F.col("batting_home"), v * h).otherwise(v)))
    return rows.withColumn("raw", scaled).withColumn("probabilities", normalised(F.col("raw"))).drop("raw", "batter", "pitcher", "prior")
