"""Price conversions as column expressions.  American odds round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean even money, include flags, and the floor of American odds
EVEN_MONEY = ("EV", "EVEN", "PK", "PICK", "PICKEM", "PICK'EM")
INCLUDE_YES = ("1", "true", "yes", "y", "on", "include")
INCLUDE_NO = ("0", "false", "no", "n", "off", "skip", "exclude")
AMERICAN_FORMATS = ("american", "us", "moneyline")
DECIMAL_FORMATS = ("decimal", "eu", "european")
SHORTEST_PRICE = -100000
MINIMUM_ROI = 0.02


def american_to_decimal(odds: Column) -> Column:
    return 1.0 + F.when(odds > 0, odds / 100.0).when(odds < 0, 100.0 / F.abs(odds))


def implied_probability(odds: Column) -> Column:
    return 1.0 / american_to_decimal(odds)


def decimal_to_american(price: Column) -> Column:
    profit = price - 1.0
    return F.when(profit >= 1.0, F.rint(profit * 100.0)).when(profit > 0, F.rint(-100.0 / profit)).cast("int")


def probability_to_american(p: Column) -> Column:
    favourite = F.rint(-100.0 * p / (1.0 - p))
    return F.when((p >= 0.5) & (p < 1.0), favourite).when((p > 0.0) & (p < 0.5), F.rint(100.0 * (1.0 - p) / p)).cast("int")


def no_vig(first: Column, second: Column) -> Column:
    """The first side's implied probability after removing the margin of a two-way market."""
    a, b = implied_probability(first), implied_probability(second)
    return a / (a + b)


def parse_odds(text: Column, odds_format: Column) -> Column:
    """American odds from typed text, NULL where the text is not a valid price."""
    word, kind = F.upper(F.trim(text)), F.lower(F.trim(F.coalesce(odds_format, F.lit("american"))))
    number = F.regexp_replace(word, ",", "").try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) >= 100), number.cast("int"))
    american = F.when(word.isin(*EVEN_MONEY), 100).otherwise(whole)
    price = F.regexp_replace(word, ",", ".").try_cast("double")
    return F.when(kind.isin(*AMERICAN_FORMATS), american).when(kind.isin(*DECIMAL_FORMATS), decimal_to_american(price))


def expected_roi(win: Column, push: Column, odds: Column) -> Column:
    return win * (american_to_decimal(odds) - 1.0) - F.greatest(F.lit(0.0), 1.0 - win - push)


def break_even(push: Column, odds: Column) -> Column:
    return (1.0 - push) / american_to_decimal(odds)


def price_at(win: Column, push: Column, required_roi: float) -> Column:
    """American odds that return ``required_roi``; NULL when the outcome cannot win."""
    price = (1.0 + required_roi - push) / F.nullif(win, F.lit(0.0))
    return F.when(price <= 1.0, SHORTEST_PRICE).otherwise(decimal_to_american(price))
