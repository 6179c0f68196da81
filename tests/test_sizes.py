"""What keeps a job's share per task, and per pass small: plans, cuts and shuffles."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from slatewise.operators import experiments, history, learners, market, metrics, positions
from slatewise.plans import source_queries
from slatewise.session import size_shuffles


def test_the_cut_agrees_with_the_index(spark):
    day = lambda i: datetime.date(2024, 4, 1) + datetime.timedelta(days=i // 60)
    rows = spark.createDataFrame([(i, day(i)) for i in range(200)], "game_pk long, game_date date")
    indexed = {r["game_pk"]: r["row_index"] for r in metrics.chronological_index(rows, "game_date", "game_pk").collect()}
    for at in (0, 1, 59, 60, 133, 199, 200):
        late = {r["game_pk"] for r in rows.where(metrics.chronological_cut(rows, "game_date", "game_pk", at)).collect()}
        assert late == {k for k, i in indexed.items() if i >= at}


def test_wide_team_values_are_made_once_per_pair_and_date(spark):
    day = datetime.date(2024, 4, 1)
    rows = spark.createDataFrame([(i, day, "A", "B") for i in range(5)], "game_pk long, game_date date, team_a string, team_b string")
    teams = spark.createDataFrame([("A", day, 3.0), ("B", day, 1.0)], "team string, game_date date, rf_pg double")
    assert [tuple(r)[3:] for r in history.pair_differences(rows, teams, ["rf_pg"]).collect()] == [(2.0, 4.0)]


def test_shuffles_start_in_proportion_to_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size_shuffles(spark, 1_000)
    assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    size_shuffles(spark, 36_000_000)
    assert spark.range(10).repartition(F.col("id")) and int(spark.conf.get(name)) == 360
    size_shuffles(spark, 1_000)


def test_a_constant_feature_has_no_spread(spark):
    rows = spark.createDataFrame([(i, datetime.date(2024, 4, 1 + i // 10), i % 2, 0.1, float(i)) for i in range(30)], "game_pk long, game_date date, a_win int, c double, x double")
    scale = experiments.window_scales(experiments.plain(rows, ["c", "x"]), ["c", "x"], [("w", "2024-04-03", "2024-04-09")], 10)[0]
    assert scale.spreads[0] == 1.0 and abs(scale.products[0, 0]) < 1e-12 and np.isclose(scale.products[1, 1], 1.0)


def test_neighbours_run_no_frame_anew_for_every_row(spark, capsys):
    rows = spark.createDataFrame([("A", i, i if i % 4 == 0 else None) for i in range(40)], "k string, at int, v int")
    found = positions.neighbours(rows, ["k"], [F.col("at")], F.col("v"))
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    got = {r["at"]: (r["_last"], r["_next"]) for r in found.collect()}
    assert all(got[i] == ((i - 1) // 4 * 4 if i else None, (i // 4 + 1) * 4 if i < 36 else None) for i in range(40))


def test_even_odds_of_one_book_always_resolve_alike(spark):
    quotes = [(1, "moneyline", "H", None, None, "B0", odds) for odds in (-100, 100)]
    schema = "game_pk long, market_type string, selection string, line double, team string, sportsbook string, american_odds int"
    for rows in (quotes, quotes[::-1]):
        assert market.best_quote_per_market(spark.createDataFrame(rows, schema).coalesce(1)).first()["american_odds"] == 100


def test_a_larger_feed_takes_no_more_batches():
    for files in (1, 8, 33, 500, 10_000):
        assert -(-files // source_queries.files_per_batch(files)) <= source_queries.STREAM_BATCHES


def test_fits_pass_over_packed_blocks_of_all_earlier_rows(spark, monkeypatch):
    monkeypatch.setattr(experiments, "BLOCK_ROWS", 7)
    day = lambda i: datetime.date(2024, 4, 1 + i % 9)
    rows = experiments.plain(spark.createDataFrame([(i, day(i), i % 2, float(i), None if i % 5 == 0 else float(i % 5)) for i in range(90)], "game_pk long, game_date date, a_win int, x double, gap double"), ["x", "gap"])
    blocks = experiments.packed(rows, ["x", "gap"], "2024-04-08")
    assert blocks.count() >= 10 and set(blocks.columns) == {"days", "wins", "matrix"}
    sums = experiments._summed(blocks, ["2024-04-03", "2024-04-08"], lambda w, x, y: np.array([len(y), y.sum(), x[:, 0].sum(), np.isnan(x[:, 1]).sum()]), 4)
    for got, last in zip(sums, (2, 7), strict=True):
        early = [i for i in range(90) if i % 9 < last]
        assert got.tolist() == [len(early), sum(i % 2 for i in early), sum(early), sum(i % 5 == 0 for i in early)]


def test_boosted_components_share_one_preparation_and_score_as_alone(spark, monkeypatch):
    monkeypatch.setattr(learners, "BOOST_ROUNDS", 2)
    made, plain = [], learners.preparation
    monkeypatch.setattr(learners, "preparation", lambda *given: made.append(1) or plain(*given))
    day = lambda i: datetime.date(2024, 4, 1) + datetime.timedelta(days=i // 10)
    rows = spark.createDataFrame([(i, day(i), int(i % 7 > 2), float(i % 7), None if i % 11 == 0 else float(i % 5)) for i in range(300)], "game_pk long, game_date date, a_win int, x double, gap double")
    together = learners.fit_components(rows, ["x", "gap"], list(learners.BOOSTED))
    assert list(together) == list(learners.BOOSTED) and len(made) == 1
    scores = lambda frame: {r["game_pk"]: round(r["p"], 12) for r in frame.collect()}
    assert scores(together["catboost"]) == scores(learners.fit_component(rows, ["x", "gap"], "catboost"))


def test_fits_that_keep_blocks_get_no_second_copy_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(learners, "FOREST", {**learners.FOREST, "numTrees": 2})
    kept, plain = {}, learners._classify
    monkeypatch.setattr(learners, "_classify", lambda model, train, test: kept.setdefault(type(model).__name__, train.storageLevel.useMemory) and None or plain(model, train, test))
    day = lambda i: datetime.date(2024, 4, 1) + datetime.timedelta(days=i // 10)
    rows = spark.createDataFrame([(i, day(i), int(i % 7 > 2), float(i % 7), float(i % 5)) for i in range(300)], "game_pk long, game_date date, a_win int, x double, gap double")
    for name in ("logistic", "random_forest"):
        assert learners.fit_component(rows, ["x", "gap"], name).count() == 60
    assert kept == {"LogisticRegression": False, "RandomForestClassifier": True}
