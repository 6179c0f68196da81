"""Score distributions: folded where the draws lie, one row a game however its draws arrive."""

import numpy as np
from pyspark.sql import functions as F

from slatewise.operators import market, scores
from slatewise.plans import load_all
from slatewise.sources.adapters import Tables

FOLDER = "/root/testdata/sf0.001"
CELLS = "game_pk long, away_runs int, home_runs int"


def test_cells_hold_every_score_once_however_draws_arrive(spark):
    draws = [(g, g % 3 + d % 4, d % 5) for g in range(40) for d in range(60)]
    want = {}
    for g, a, h in draws:
        want[g, a, h] = want.get((g, a, h), 0) + 1
    spread = spark.createDataFrame(draws, CELLS).repartition(7, F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for rows in (spark.createDataFrame(draws, CELLS), spread):
            found = scores.score_cells(rows).collect()
            assert sorted(r["game_pk"] for r in found) == list(range(40)) and {r["draws"] for r in found} == {60}
            assert {(r["game_pk"], a, h): n for r in found for a, h, n in zip(*(r[c] for c in scores.CELLS), strict=True)} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_draw_without_a_score_counts_as_a_draw(spark):
    row = scores.score_cells(spark.createDataFrame([(1, None, 2), (1, 3, 2), (1, None, 2)], CELLS)).first()
    assert row["draws"] == 3 and sorted(zip(row["away_runs"], row["home_runs"], row["n"]), key=str) == [(3, 2, 1), (None, 2, 2)]


def test_no_draw_is_shuffled_or_written(spark, capsys):
    t = Tables(spark, FOLDER)
    scores.score_cells(t.draws).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Generate explode" in plan


def test_the_best_quotes_may_be_chosen_before_they_are_priced(spark):
    t = Tables(spark, FOLDER)
    quotes, cells = t.quotes, market.score_cells(t.draws)
    columns = ["market_key", "sportsbook", "american_odds", "win_probability", "push_probability"]
    late = market.best_quote_per_market(market.price_quotes(quotes, cells)).select(*columns)
    early = market.best_priced(quotes, cells).select(*columns)
    assert early.count() == late.count() > 0 and early.exceptAll(late).count() == 0


def test_scans_are_cut_like_shuffles(spark):
    load_all()["active_sportsbooks"].run(spark, FOLDER)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_sparse_and_dense_scores_fold_alike(monkeypatch):
    game, away, home = np.repeat([5, 9, 5], 4), np.array([1, 1, 2, 1] * 3), np.array([0, 0, 3, 0] * 3)
    dense = scores.folded(game, away, home, np.ones(12, np.int64))
    monkeypatch.setattr(scores, "DENSE", 0)
    for a, b in zip(dense, scores.folded(game, away, home, np.ones(12, np.int64)), strict=True):
        assert a.tolist() == b.tolist()
