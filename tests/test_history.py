import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slatewise.operators import context, history

CONTEST = "game_pk long, game_date date, team_a string, team_b string, a_runs int, b_runs int, a_win int, a_starter string, b_starter string, team_a_is_home int"


def contest(pk, day, a, b, ar, br, home=1):
    return (pk, dt.date(2020, 1, 1) + dt.timedelta(days=day), a, b, ar, br, int(ar > br), f"s{a}", f"s{b}", home)


def league(seed=7, days=40, per_day=3):
    rng, rows = random.Random(seed), []
    for pk in range(days * per_day):
        a, b = sorted(rng.sample("ABCDE", 2))
        ar, br = rng.sample(range(10), 2)
        rows.append(contest(pk, pk // per_day, a, b, ar, br, rng.randint(0, 1)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, CONTEST)


def naive_state(rows, team, day):
    """The state of one team before a date, replayed game by game."""
    past = []
    for pk, date, a, b, ar, br, win, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if date < day and team in (a, b):
            past.append((win, ar, br) if team == a else (1 - win, br, ar))
    ewm = 4.35
    for _, rf, _ in past:
        ewm = 0.25 * rf + 0.75 * ewm
    last = past[-3:]
    rf3 = sum(r for _, r, _ in last) / len(last) if last else 4.35
    n, wins = len(past), sum(w for w, _, _ in past)
    return n, (wins + 5) / (n + 10), rf3, ewm


def test_state_matches_game_by_game_replay(spark):
    rows = league()
    games = history.team_games(frame(spark, rows))
    joined = history.season_strength(games).join(history.rolling_form(games), history.KEY).join(history.ewm_form(games), history.KEY)
    got = joined.collect()
    assert got
    for r in got:
        n, win, rf3, ewm = naive_state(rows, r.team, r.game_date)
        assert (r.games, r.win_pct, r.rf3, r.ewm_rf) == (n, pytest.approx(win), pytest.approx(rf3), pytest.approx(ewm)), r


def test_weighted_form_spans_more_games_than_one_block(spark):
    rows = league(3, days=260, per_day=4)
    got = history.ewm_form(history.team_games(frame(spark, rows))).filter(F.col("game_date") > F.lit(dt.date(2020, 9, 1))).collect()
    assert got
    for r in got[:40]:
        assert r.ewm_rf == pytest.approx(naive_state(rows, r.team, r.game_date)[3], abs=1e-9)


def test_three_game_form_values(spark):
    rows = [contest(1, 0, "A", "B", 6, 2), contest(2, 1, "A", "B", 1, 5), contest(3, 2, "A", "B", 4, 3), contest(4, 3, "A", "B", 9, 0)]
    last = history.matchup_features(frame(spark, rows)).filter("game_pk = 4").first()
    assert last.win3_diff == pytest.approx(1 / 3)
    assert last.rf3_sum == pytest.approx(7)
    assert last.rd3_diff == pytest.approx(2 / 3)


def test_own_result_never_moves_own_features(spark):
    rows = league(11, 15)
    target = rows[30]
    changed = [contest(*((r[0], (r[1] - dt.date(2020, 1, 1)).days, r[2], r[3], 25, 0, r[9]))) if r is target else r for r in rows]
    pick = lambda data: {
        r.game_pk: r.asDict() for r in history.matchup_features(frame(spark, data), opponent_adjusted=True).drop("a_runs", "b_runs", "a_win").filter(F.col("game_date") <= F.lit(target[1])).collect()
    }
    assert pick(rows) == pick(changed)


def test_future_path_equals_history_path(spark):
    rows = league(5, 20)
    cut = dt.date(2020, 1, 1) + dt.timedelta(days=19)
    past, day = [r for r in rows if r[1] < cut], [r for r in rows if r[1] == cut]
    whole = history.matchup_features(frame(spark, rows)).filter(F.col("game_date") == F.lit(cut)).drop("a_runs", "b_runs", "a_win")
    targets = spark.createDataFrame(
        [(r[0], r[1], r[3] if r[9] else r[2], r[2] if r[9] else r[3], f"s{r[3] if r[9] else r[2]}", f"s{r[2] if r[9] else r[3]}") for r in day],
        "game_pk long, game_date date, away_team string, home_team string, away_starter string, home_starter string",
    )
    future = history.future_features(frame(spark, past), targets)
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(whole.columns)).collect())
    assert key(whole) == key(future)
    with pytest.raises(ValueError):
        history.future_features(frame(spark, rows), targets)


def test_series_opener_and_running_series(spark):
    rows = [contest(1, 0, "A", "B", 1, 4), contest(2, 1, "A", "B", 2, 7), contest(3, 2, "A", "B", 5, 1), contest(4, 2, "C", "D", 5, 1), contest(5, 3, "A", "C", 5, 1)]
    base = frame(spark, rows)
    slate = base.select("game_pk", "game_date", F.col("team_b").alias("away_team"), F.col("team_a").alias("home_team"))
    got = {r.game_pk: r for r in context.series_summary(context.series_islands(slate, history.team_games(base))).collect()}
    assert got[1].status == "SERIES_OPENER" and got[5].status == "SERIES_OPENER"
    third = got[3]
    assert (third.status, third.games_played, third.away_wins, third.home_wins) == ("COMPLETE", 2, 2, 0)
    assert (third.run_differential, third.home_losing, third.latest_loser, third.latest_margin) == (8, 2, "A", 5)
    assert third.summary == "B leads 2-0; B +8 runs"
