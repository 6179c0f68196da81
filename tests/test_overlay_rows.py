"""The overlay's rows stay off the driver."""

import datetime

from slatewise.operators import snapshots
from slatewise.operators.context import CONTEXT_FEATURES


def test_overlay_rows_are_never_broadcast(spark, capsys):
    at = datetime.datetime(2024, 4, 1, 10)
    kinds = "sequence long, game_pk long, event_type string, recorded_at timestamp_ntz, game_date date, away_team string, home_team string, home_probability double, production_home_probability double, home_odds int, away_odds int, offered_home_implied double, selection_status string, selection_reasons string, home_won int, closing_home_implied double"
    prediction = (1, 7, "prediction", at, at.date(), "A", "B", 0.6, 0.6, 100, 100, 0.5, "PASS", "", None, None)
    outcome = (2, 7, "outcome", at, at.date(), "A", "B", None, None, None, None, None, None, None, 1, None)
    payloads = spark.createDataFrame([(7, f'{{"{CONTEXT_FEATURES[0]}": 2.5}}')], "game_pk long, context_features string")
    frame = snapshots.overlay_training_frame(spark.createDataFrame([prediction, outcome], kinds), payloads)
    frame.explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
    row = frame.first()
    assert row["home_won"] == 1 and row[CONTEXT_FEATURES[0]] == 2.5 and row[CONTEXT_FEATURES[1]] == 0.0
