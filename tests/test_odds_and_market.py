import pytest
from pyspark.sql import functions as F

from slatewise.functions import odds
from slatewise.operators import market

QUOTE = "game_pk long, sportsbook string, market_type string, selection string, team string, line double, american_odds int, captured_at string, event_date string, home_team string, away_team string"


def quote(kind, selection, price=-110, line=None, team=None, book="B", at="2020-01-01", pk=1):
    return (pk, book, kind, selection, team, line, price, at, "2020-01-01", "HOM", "AWY")


def valued(spark, win, push, price, **flags):
    rows = spark.createDataFrame([quote("moneyline", "HOM", price) + (win, push)], QUOTE + ", win_probability double, push_probability double")
    return market.value_quotes(rows.withColumns({k: F.lit(v) for k, v in flags.items()})).first()


def test_price_conversions(spark):
    rows = spark.createDataFrame(
        [("2.25", "decimal", 125), ("1,5", "eu", -200), ("EVEN", None, 100), ("-95", "us", None), ("+1,250", "american", 1250), ("pick'em", "us", 100), ("x", "us", None), ("101.5", "us", None)],
        "text string, fmt string, expected int",
    )
    for row in rows.withColumn("got", odds.parse_odds(F.col("text"), F.col("fmt"))).collect():
        assert row.got == row.expected, row


def test_american_odds_round_half_to_even(spark):
    row = spark.range(1).select(odds.decimal_to_american(F.lit(2.125)).alias("a"), odds.decimal_to_american(F.lit(2.135)).alias("b")).first()
    assert row.a == 112 and row.b in (113, 114)


def test_quote_valuation_statuses(spark):
    play = valued(spark, 0.58, 0.0, -120)
    assert play.status == "PLAY" and play.expected_roi == pytest.approx(0.0633333, abs=1e-6)
    assert (play.fair_odds, play.playable_through) == (-138, -132)
    assert valued(spark, 0.50, 0.10, -110).expected_roi == pytest.approx(0.05454545, abs=1e-7)
    assert valued(spark, 0.58, 0.0, -120, fresh=False, conflict=True).status == "PASS_STALE"
    assert valued(spark, 0.58, 0.0, -120, conflict=True).status == "PASS_CONFLICT"
    assert valued(spark, 0.10, 0.0, -120).status == "NO_EDGE"
    assert valued(spark, 0.0, 0.0, -120).fair_odds is None


def test_pricing_against_draws(spark):
    draws = spark.createDataFrame([(1, a, h) for a, h in zip((5, 4, 3, 2), (3, 4, 5, 1), strict=True)], "game_pk long, away_runs int, home_runs int")
    quotes = spark.createDataFrame(
        [quote("moneyline", "AWY"), quote("run_line", "AWY", line=-1.5), quote("game_total", "OVER", line=7.0), quote("team_total", "OVER", line=3.5, team="AWY")], QUOTE
    )
    got = {r.market_type: (r.win_probability, r.push_probability) for r in market.price_quotes_from_draws(quotes, draws).collect()}
    assert got["moneyline"] == (0.625, 0.0)
    assert got["run_line"][0] == 0.25
    assert got["game_total"][0] == 0.75
    assert got["team_total"][0] == 0.5
    fixed = spark.createDataFrame([(1, 0.4)], "game_pk long, home_win_probability double")
    money = market.price_quotes_from_draws(quotes.filter("market_type = 'moneyline'"), draws, fixed).first()
    assert money.win_probability == pytest.approx(0.6)


def test_snapshot_diff_counts(spark):
    old = spark.createDataFrame([quote("moneyline", "HOM", -120), quote("run_line", "HOM", 110, 1.5), quote("moneyline", "HOM", 140, pk=2)], QUOTE)
    new = spark.createDataFrame([quote("moneyline", "HOM", -125), quote("run_line", "HOM", 110, -1.5)], QUOTE)
    games = spark.createDataFrame([(1,)], "game_pk long")
    status = sorted(r.status for r in market.provider_snapshot_diff(old, new, games).collect())
    assert status == ["ADDED", "PRESERVED", "REMOVED", "REPRICED"]


def test_equal_best_prices_take_the_first_book(spark):
    rows = spark.createDataFrame([quote("moneyline", "HOM", 120, book="Z"), quote("moneyline", "HOM", 120, book="A"), quote("moneyline", "HOM", 110, book="B")], QUOTE)
    best = market.best_quote_per_market(rows).collect()
    assert [(r.sportsbook, r.american_odds) for r in best] == [("A", 120)]
    assert market.best_quote_per_market(rows, ["b"]).first().american_odds == 110
