"""Season statistics in service JSON, read as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The payload layout, text that means "no value", run weights and the FIP constant
SEASON_SCHEMA = "stats array<struct<splits: array<struct<stat: map<string,string>>>>>"
MISSING_TEXT = ("", "-", "-.--", ".---", "--")
FIP_HOME_RUN, FIP_WALK, FIP_STRIKEOUT, FIP_CONSTANT = 13.0, 3.0, 2.0, 3.10
WOBA_WEIGHTS = {"walk": 0.69, "hbp": 0.72, "single": 0.88, "double": 1.247, "triple": 1.578, "homer": 2.031}


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value taken a single time, however often ``of`` names it: a plain column is repeated wherever it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def first_stat(payload: Column) -> Column:
    """The stat map of the first block that has splits."""
    blocks = F.filter(F.from_json(payload, SEASON_SCHEMA)["stats"], lambda b: F.size(b["splits"]) > 0)
    return F.try_element_at(blocks, F.lit(1))["splits"][0]["stat"]


def number(stat: Column, key: str) -> Column:
    text = F.trim(F.try_element_at(stat, F.lit(key)))
    value = F.when(~text.isin(*MISSING_TEXT), text.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def innings(text: Column) -> Column:
    """Innings notation to innings: .1 and .2 are thirds, anything else after the point is invalid."""
    text = F.trim(text)
    parts = F.split(text, r"\.", 2)
    whole, outs = F.get(parts, 0), F.get(parts, 1)
    count = F.when(whole == "", 0).otherwise(whole.try_cast("int"))
    valid = ~text.isin(*MISSING_TEXT) & (count >= 0) & (outs.isNull() | outs.isin("0", "1", "2"))
    return F.when(valid, count + F.coalesce(outs.try_cast("int"), F.lit(0)) / 3.0)


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b > 0, scale * a / b)


def fip(home_runs: Column, walks: Column, hit_batters: Column, strikeouts: Column, ip: Column) -> Column:
    points = FIP_HOME_RUN * home_runs + FIP_WALK * (walks + hit_batters) - FIP_STRIKEOUT * strikeouts
    return F.when(ip > 0, points / ip + FIP_CONSTANT)


def starter_line(payload: Column) -> dict[str, Column]:
    """Normalised starter metrics; only what the payload supports."""
    stat = first_stat(payload)
    n = {k: number(stat, k) for k in ("strikeOuts", "baseOnBalls", "hitBatsmen", "homeRuns", "battersFaced", "hits", "groundOuts", "airOuts", "era", "gamesPlayed", "gamesStarted")}
    ip = innings(F.try_element_at(stat, F.lit("inningsPitched")))
    k_rate, bb_rate = ratio(n["strikeOuts"], n["battersFaced"], 100.0), ratio(n["baseOnBalls"], n["battersFaced"], 100.0)
    return {
        "season_innings": ip,
        "season_era": n["era"],
        "games_pitched": n["gamesPlayed"],
        "games_started": n["gamesStarted"],
        "starter_fip": fip(n["homeRuns"], n["baseOnBalls"], F.coalesce(n["hitBatsmen"], F.lit(0.0)), n["strikeOuts"], ip),
        "starter_k_rate": k_rate,
        "starter_bb_rate": bb_rate,
        "starter_k_minus_bb": k_rate - bb_rate,
        "starter_k_per_9": ratio(n["strikeOuts"], ip, 9.0),
        "starter_bb_per_9": ratio(n["baseOnBalls"], ip, 9.0),
        "starter_hr_per_9": ratio(n["homeRuns"], ip, 9.0),
        "starter_hits_per_9": ratio(n["hits"], ip, 9.0),
        "starter_ground_to_air": ratio(n["groundOuts"], n["airOuts"]),
        "batters_faced": n["battersFaced"],
    }


def starter_k_rate(payload: Column) -> Column:
    """``starter_k_rate`` of :func:`starter_line` alone, from one parse of the payload."""
    rate = lambda stat: once(number(stat, "battersFaced"), lambda faced: ratio(number(stat, "strikeOuts"), faced, 100.0))
    return once(first_stat(payload), rate)


def hitter_line(payload: Column) -> dict[str, Column]:
    """Plate appearances, slash line, rates and a linear-weights on-base proxy."""
    stat = first_stat(payload)
    get = lambda k: number(stat, k)
    pa, ab, hits, doubles, triples, homers = (get(k) for k in ("plateAppearances", "atBats", "hits", "doubles", "triples", "homeRuns"))
    walks, strikeouts, hbp, flies = (get(k) for k in ("baseOnBalls", "strikeOuts", "hitByPitch", "sacFlies"))
    intentional = F.coalesce(get("intentionalWalks"), F.lit(0.0))
    avg, obp, slg = get("avg"), get("obp"), get("slg")
    singles = F.greatest(F.lit(0.0), hits - doubles - triples - homers)
    w = WOBA_WEIGHTS
    points = w["walk"] * F.greatest(F.lit(0.0), walks - intentional) + w["hbp"] * hbp + w["single"] * singles + w["double"] * doubles + w["triple"] * triples + w["homer"] * homers
    complete = ab.isNotNull() & hits.isNotNull() & doubles.isNotNull() & triples.isNotNull() & homers.isNotNull() & walks.isNotNull()
    return {
        "pa": pa,
        "obp": obp,
        "slg": slg,
        "ops": F.coalesce(get("ops"), obp + slg),
        "iso": slg - avg,
        "walk_rate": ratio(walks, pa),
        "strikeout_rate": ratio(strikeouts, pa),
        "woba_proxy": F.when(complete, ratio(points, ab + walks - intentional + flies + hbp)),
    }
