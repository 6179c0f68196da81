"""Club names and feature names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalised club names and their codes
TEAM_ALIASES = {
    "arizona diamondbacks": "AZ", "atlanta braves": "ATL", "baltimore orioles": "BAL", "boston red sox": "BOS",
    "chicago cubs": "CHC", "chicago white sox": "CWS", "cincinnati reds": "CIN", "cleveland guardians": "CLE",
    "colorado rockies": "COL", "detroit tigers": "DET", "houston astros": "HOU", "kansas city royals": "KC",
    "los angeles angels": "LAA", "la angels": "LAA", "los angeles dodgers": "LAD", "la dodgers": "LAD",
    "miami marlins": "MIA", "milwaukee brewers": "MIL", "minnesota twins": "MIN", "new york mets": "NYM", "ny mets": "NYM",
    "new york yankees": "NYY", "ny yankees": "NYY", "oakland athletics": "ATH", "sacramento athletics": "ATH",
    "athletics": "ATH", "as": "ATH", "philadelphia phillies": "PHI", "pittsburgh pirates": "PIT", "san diego padres": "SD",
    "san francisco giants": "SF", "seattle mariners": "SEA", "st louis cardinals": "STL", "saint louis cardinals": "STL",
    "tampa bay rays": "TB", "texas rangers": "TEX", "toronto blue jays": "TOR", "washington nationals": "WSH",
}

# Live model inputs
LIVE_FEATURES = (
    "lineup_wrc_plus", "lineup_xwoba", "platoon_edge", "injury_war",
    "bullpen_xfip", "bullpen_siera", "bullpen_fatigue", "closer_available",
    "umpire_run_factor", "umpire_k_factor", "park_run_factor", "park_hr_factor",
    "weather_run_factor", "air_density", "wind_out_component", "rain_risk",
    "travel_fatigue", "time_zones_crossed", "defense_frv", "defense_oaa",
    "catcher_framing", "baserunning_runs", "market_implied_probability",
    "market_move", "reverse_line_move", "starter_xera", "starter_fip",
    "starter_xfip", "starter_siera", "starter_stuff_plus", "starter_location_plus",
    "starter_pitching_plus", "starter_csw", "starter_k_minus_bb",
    "starter_hard_hit_allowed", "starter_barrel_allowed", "starter_ground_ball_rate",
    "starter_velocity_trend", "starter_spin_trend", "starter_pitch_mix_change",
    "times_through_order_penalty", "lineup_confirmed",
)

# The first rule with a matching prefix names a feature's group
FEATURE_GROUPS = (
    ("starting_pitcher", ("starter_", "times_through_order_penalty")),
    ("bullpen", ("bullpen_", "closer_available")),
    ("lineup", ("lineup_", "platoon_edge")),
    ("injuries", ("injury_",)),
    ("defense", ("defense_", "catcher_framing")),
    ("baserunning", ("baserunning_",)),
    ("rest_and_travel", ("travel_", "time_zones_crossed", "rest_days", "games_last3", "games_last7")),
    ("park_and_umpire", ("umpire_", "park_")),
    ("weather", ("weather_", "air_density", "wind_out_component", "rain_risk")),
    ("market", ("market_", "reverse_line_move")),
    ("recent_form", ("opp_adj_",)),
    ("recent_form", ("last_", *(f"{m}{n}" for m in ("win", "rf", "ra", "rd") for n in (3, 5, 10, 20)), "ewm_", "form_")),
    ("offense", ("rf_pg",)),
    ("run_prevention", ("ra_pg", "run_diff_pg")),
    ("team_strength", ("games_diff", "win_pct", "pyth")),
)
HOME_FIELD = ("team_a_is_home", "missing_home_away")


def feature_group(name: Column) -> Column:
    """Group of a feature name; NULL when no rule knows it."""
    base = F.regexp_replace(name, "^(live|missing)_", "")
    chain = F.when(name.isin(*HOME_FIELD), "home_field")
    for group, prefixes in FEATURE_GROUPS:
        chain = chain.when(reduce(lambda a, b: a | b, [base.startswith(p) for p in prefixes]), group)
    return chain


def feature_group_of(name: str) -> str:
    """The same rules for a column name, to build projections."""
    if name in HOME_FIELD:
        return "home_field"
    base = name.removeprefix("live_") if name.startswith("live_") else name.removeprefix("missing_")
    for group, prefixes in FEATURE_GROUPS:
        if base.startswith(tuple(prefixes)):
            return group
    raise ValueError(f"feature {name!r} belongs to no group")


def normalise_name(name: Column) -> Column:
    """Lower case, & spelled out, everything but letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
