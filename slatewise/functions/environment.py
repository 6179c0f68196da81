"""Weather and travel as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.status import has_any

# Text tokens, coefficients and bounds
WIND_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*mph"
WIND_OUT = ("out to", "out toward", "blowing out")
WIND_IN = ("in from", "blowing in")
WIND_CROSS = ("left to right", "right to left", "cross")
ROOF_CLOSED = ("closed", "dome", "indoor")
RAIN = ("rain", "shower", "drizzle", "storm")
CLOUD = ("cloud", "overcast")
EARTH_RADIUS_MILES = 3958.7613


def _clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def weather(temperature: Column, wind: Column, roof: Column, condition: Column) -> dict[str, Column]:
    """Run factor, air density, signed wind and rain risk; a closed roof neutralises all."""
    speed = F.regexp_extract(F.coalesce(wind, F.lit("")), WIND_PATTERN, 1).try_cast("double")
    text = F.lower(F.coalesce(wind, F.lit("")))
    signed = F.when(has_any(text, WIND_OUT), speed).when(has_any(text, WIND_IN), -speed).when(has_any(text, WIND_CROSS) & speed.isNotNull(), 0.0)
    closed = has_any(F.lower(F.coalesce(roof, F.lit(""))), ROOF_CLOSED)
    sky = F.lower(F.coalesce(condition, F.lit("")))
    factor = 1.0 + F.coalesce(0.0025 * (temperature - 70.0), F.lit(0.0)) + F.coalesce(0.0040 * signed, F.lit(0.0))
    neutral = lambda value, other: F.when(closed, value).otherwise(other)
    return {
        "weather_run_factor": neutral(1.0, _clip(factor, 0.88, 1.12)),
        "air_density": neutral(1.0, _clip(1.0 - 0.0018 * (temperature - 70.0), 0.90, 1.10)),
        "wind_out_component": neutral(0.0, signed),
        "rain_risk": neutral(0.0, F.when(has_any(sky, RAIN), 0.75).when(has_any(sky, CLOUD), 0.15).otherwise(0.0)),
        "wind_speed_mph": speed,
    }


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return EARTH_RADIUS_MILES * 2 * F.asin(F.sqrt(h))


def travel(distance: Column, zones: Column, rest: Column, density: Column) -> Column:
    """Travel fatigue in [0, 1.5]; NULL when neither distance nor zones are known."""
    rest, density = F.coalesce(rest, F.lit(3.0)), F.coalesce(density, F.lit(0.0))
    part = lambda c, scale: F.coalesce(F.least(c / scale, F.lit(1.0)), F.lit(0.0)) * c.isNotNull().cast("int")
    load = part(distance, 2800.0) + part(zones, 3.0) * 0.45 + F.greatest(F.lit(0.0), 2.0 - rest) * 0.20 + F.greatest(F.lit(0.0), density - 2.0) * 0.15
    return F.when(distance.isNotNull() | zones.isNotNull(), _clip(load, 0.0, 1.5))
