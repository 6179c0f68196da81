import math

import pytest
from pyspark.sql import functions as F

from slatewise.functions.season_lines import innings
from slatewise.operators import ensemble, experiments, features, identity, ledger, metrics, pitching, resampling
from slatewise.operators.positions import position


def test_probability_metrics_values(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9), (1, None)], "y int, p double")
    m = metrics.probability_metrics(rows, "y", "p", bins=2).first()
    assert (m.n_total, m.n, m.coverage) == (5, 4, 0.8)
    assert m.brier == pytest.approx(0.025) and m.ece == pytest.approx(0.15) and m.auc == 1.0
    one_class = metrics.probability_metrics(rows.filter("y = 1"), "y", "p").first()
    assert one_class.auc is None


def test_auc_with_ties_matches_pairwise_count(spark):
    data = [((i * 7) % 3 % 2, ((i * 13) % 11) / 11) for i in range(60)]
    got = metrics.auc_rank(spark.createDataFrame(data, "y int, p double"), "y", "p").first().auc
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(expected)


def test_bins_at_edges(spark):
    rows = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "p double")
    left = [r[0] for r in rows.select(metrics.left_closed_bin(F.col("p"), 10)).collect()]
    right = [r[0] for r in rows.select(metrics.right_closed_bin(F.col("p"), 10)).collect()]
    assert left == [2, 3, 9, 0] and right == [2, 2, 9, 0]


def test_positions_equal_a_plain_sort(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "k int, v int")
    got = position(rows, ["k"], [F.col("v")], "n").collect()
    for k in (0, 1):
        assert [r.n for r in sorted((r for r in got if r.k == k), key=lambda r: r.v)] == list(range(1, sum(r.k == k for r in got) + 1))


def test_exact_medians(spark):
    rows = spark.createDataFrame([(float(v), float(v * v)) for v in (5, 1, 4, 2)] + [(None, 1.0)], "a double, b double")
    got = {r.feature: r.median for r in features.exact_medians(rows, ["a", "b"]).collect()}
    assert got == {"a": 3.0, "b": 4.0}


def test_selection_prefers_log_loss_then_brier(spark):
    base = {"accuracy": 0.55, "auc": 0.56, "ece": 0.02, "feature_count": 5}
    rows = [
        {"candidate": "base", "log_loss": 0.69, "brier": 0.25, **base},
        {"candidate": "good", "log_loss": 0.68, "brier": 0.24, **base},
        {"candidate": "better", "log_loss": 0.67, "brier": 0.245, **base},
        {"candidate": "drops", "log_loss": 0.60, "brier": 0.20, **{**base, "auc": 0.5}},
    ]
    got = {r.candidate: r for r in metrics.select_candidate(spark.createDataFrame(rows), "base").collect()}
    assert got["base"].selected == "better" and got["base"].reasons == "baseline"
    assert not got["drops"].eligible and got["drops"].reasons == "auc_regression"


def test_ties_and_outliers_spread(spark):
    """One tied value and one outlier: no range holds more than its share."""
    from slatewise.operators.positions import _ranged

    tied = spark.range(20_000).select("id", F.lit(0.5).alias("v")).union(spark.createDataFrame([(99_999, 1e12)], "id long, v double"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r["count"] for r in _ranged(tied, [], [F.desc("v"), F.col("id")]).groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(held) == 20_001 and len(held) > 1 and max(held) < 2 * 20_001 / len(held)
    medians = {r.feature: r.median for r in features.exact_medians(tied, ["v"]).collect()}
    assert medians == {"v": 0.5}


def test_bootstrap_covers_the_point(spark):
    rows = spark.createDataFrame([(i, i % 2, 0.4 + 0.2 * (i % 2), 0.3 + 0.4 * (i % 2)) for i in range(200)], "pk long, y int, b double, c double")
    got = {r.metric: r for r in resampling.paired_bootstrap(rows, "y", "b", "c", "pk", 10).collect()}
    assert got["brier"].point == pytest.approx(0.09 - 0.16) and got["brier"].bootstrap_samples == 10
    assert got["brier"].low <= got["brier"].point <= got["brier"].high


EVENT = "stream long, schema_version int, sequence long, event_type string, game_pk long, recorded_at string, scheduled_start string, source string, snapshot_sha256 string, provenance string, payload string, previous_event_sha256 string, event_sha256 string"


def chain(spark, n, at=None, schema=1, **changes):
    """A sound ledger of n events; `changes` are written over event `at` after its digest was taken."""
    import hashlib

    names = [c.split()[0] for c in EVENT.split(", ")]
    rows, previous = [], None
    for i in range(1, n + 1):
        version = schema if i == at else 1
        fields = [version, i, "outcome", 1, "2024-05-01 20:00", "2024-05-01 18:00", "feed", None, "{}", f'{{"n":{i}}}']
        text = "|".join("~" if f is None else str(f) for f in fields)
        digest = hashlib.sha256(f"{text}|{previous or ''}".encode()).hexdigest()
        rows.append([1, *fields, previous, digest])
        previous = digest
    for name, value in changes.items():
        rows[at - 1][names.index(name)] = value
    return spark.createDataFrame(rows, EVENT)


def test_hash_chain(spark):
    verdict = lambda frame: tuple(ledger.hash_chain_verify(frame).select("status", "first_break", "problem", "events").first())
    assert verdict(chain(spark, 20)) == ("PASS", None, None, 20)
    for field, value in (("payload", '{"n":99}'), ("recorded_at", "2024-05-10 20:00"), ("provenance", '{"feed":"forged"}'), ("snapshot_sha256", "0" * 64)):
        assert verdict(chain(spark, 20, at=7, **{field: value})) == ("FAIL", 7, "hash_mismatch", 20)
    assert verdict(chain(spark, 20).filter("sequence <> 5")) == ("FAIL", 6, "sequence_gap", 19)
    assert verdict(chain(spark, 20, at=4, schema=2)) == ("FAIL", 4, "unsupported_schema", 20)


def test_a_fork_is_a_break(spark):
    fork = chain(spark, 3).filter("sequence = 3").withColumns({"payload": F.lit("{}"), "event_sha256": F.lit("f" * 64)})
    got = ledger.hash_chain_verify(chain(spark, 3).unionByName(fork)).first()
    assert (got.status, got.first_break, got.problem, got.events) == ("FAIL", 3, "repeated_sequence", 4)


def test_large_values_do_not_cancel(spark):
    names = ("home_bullpen_fatigue",)
    rows = spark.createDataFrame([(1e9 + i % 2, 0.0) for i in range(200)], "live_home_bullpen_fatigue double, missing_home_bullpen_fatigue double")
    assert features.feature_authority(rows, names).first().variance == pytest.approx(0.25)


def test_shared_folder_must_be_named_off_local(spark):
    from slatewise.session import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert shared_dir(Session) == "hdfs://shared"


def test_indented_json_is_read_and_other_layouts_fail(spark, tmp_path):
    import json

    from slatewise.sources import files

    quote = {"game_pk": "1", "away_team": "A", "home_team": "H", "away_odds": "110", "home_odds": "-120"}
    (tmp_path / "doc.json").write_text(json.dumps({"moneylines": [quote, quote]}, indent=2))
    (tmp_path / "list.json").write_text(json.dumps([quote] * 3, indent=2))
    assert files.scan_quotes_file(spark, str(tmp_path / "doc.json"), "document").count() == 2
    assert files.scan_quotes_file(spark, str(tmp_path / "list.json"), "json").count() == 3
    (tmp_path / "tree" / "a").mkdir(parents=True)
    (tmp_path / "tree" / "a" / "x.json").write_text(json.dumps({"schema_version": 1, "kind": "k", "identity": "i", "payload": "p"}, indent=2))
    assert files.scan_snapshot_tree(spark, str(tmp_path / "tree"), "k").count() == 1
    for wrong in (lambda: files.scan_quotes_file(spark, str(tmp_path / "doc.json"), "document", lines=True), lambda: files.scan_quotes_file(spark, str(tmp_path / "list.json"), "document"), lambda: files.scan_snapshot_tree(spark, str(tmp_path / "tree"), lines=True)):
        with pytest.raises(Exception):  # noqa: B017
            wrong().collect()


def test_forbidden_keys_at_any_depth(spark):
    rows = spark.createDataFrame([('{"a":{"b":[{" Winner ":1}]}}',), ('{"a":"winner"}',), ('{"home_won":1}',)], "payload string")
    got = [r[0] for r in rows.select(ledger.forbidden_key(F.col("payload"))).collect()]
    assert got == ["Winner", None, "home_won"]


def test_abstention_audit(spark):
    event = "game_pk long, sequence long, event_type string, away_team string, home_team string, home_probability double, selection_status string, selection_reasons string, home_won int"
    rows = []
    for pk, p, status, why, won in ((1, 0.6, "PASS", "LOW_OVERLAP;LOW_PROBABILITY", 0), (2, 0.7, "PASS", "LOW_OVERLAP", 1), (3, 0.4, "ELIGIBLE", "", 0)):
        rows += [(pk, pk * 2, "prediction", "A", "H", p, status, why, None), (pk, pk * 2 + 1, "outcome", None, None, None, None, None, won)]
    audit = ledger.abstention_audit(spark.createDataFrame(rows, event)).first()
    assert audit.helpful_pass_rate == 0.5 and audit.raw_accuracy == pytest.approx(2 / 3)
    assert audit.eligible_accuracy == 1.0 and audit.coverage == pytest.approx(1 / 3) and audit.evidence_status == "PENDING"
    reasons = {r.reason: (r.games, r.raw_losses) for r in ledger.abstention_by_reason(spark.createDataFrame(rows, event)).collect()}
    assert reasons == {"LOW_OVERLAP": (2, 1), "LOW_PROBABILITY": (1, 1)}


def test_innings_notation(spark):
    rows = spark.createDataFrame([("100.2",), ("12.3",), ("7",), (".1",), ("-.--",), ("x",), ("6.",)], "ip string")
    got = [r[0] for r in rows.select(innings(F.col("ip"))).collect()]
    assert got[0] == pytest.approx(100 + 2 / 3) and got[2] == 7 and got[3] == pytest.approx(1 / 3)
    assert got[1] is None and got[4] is None and got[5] is None and got[6] is None


def test_bullpen_usage_example(spark):
    columns = "game_pk long, team string, pitcher_id long, is_starter int, outs long, pitches long, saves int"
    rows = spark.createDataFrame([(1, "A", 1, 1, 15, 80, 0), (1, "A", 2, 0, 4, 18, 1), (1, "A", 3, 0, 2, 12, 1)], columns)
    recent = spark.createDataFrame([("A", "d", 1, 0)], "team string, target_date string, game_pk long, days_ago int")
    got = pitching.bullpen_usage(recent, rows).first()
    assert (got.relief_pitches, got.relief_innings, got.closer_available) == (30.0, 2.0, 0.0)
    assert got.fatigue == pytest.approx(30 / 125) and math.isclose(got.appearances, 2.0)


def test_club_names(spark):
    rows = spark.createDataFrame([("St. Louis Cardinals",), (" nyy ",), ("N.Y. & Co",), ("ATHLETICS",)], "name string")
    got = {r.name: r.team_code for r in features.team_name_normalise(rows, "name", features.club_aliases(spark)).collect()}
    assert got == {"St. Louis Cardinals": "STL", " nyy ": "NYY", "N.Y. & Co": None, "ATHLETICS": "ATH"}


def test_a_hot_pair_meets_two_starts_an_event(spark):
    import random

    rng = random.Random(3)
    starts = [(k, "A", "B", rng.randrange(3_000_000)) for k in range(10_000)] + [(20_000, "A", "B", None), (30_000, "C", "D", None)]
    events = [(k, "A", "B", rng.randrange(-50_000, 3_100_000)) for k in range(500)] + [(900, "A", "B", None), (901, "C", "D", 5), (902, "X", "Y", 5)]
    contexts = spark.createDataFrame(starts, "game_pk long, away_team string, home_team string, start long")
    frame = spark.createDataFrame(events, "event_id long, away_team string, home_team string, commence long")
    got = {r["event_id"]: (r["game_pk"], r["gap"]) for r in identity.nearest_event_match(frame, contexts, 28_800).collect()}
    times = [(s, pk) for pk, a, _, s in starts if a == "A" and s is not None]
    for event, team, _, commence in events[:500]:
        gap = min(abs(s - commence) for s, _ in times)
        near = [pk for s, pk in times if abs(s - commence) == gap]
        assert got[event] == ((near[0] if len(near) == 1 else None, gap) if gap <= 28_800 else (None, None)), (event, team)
    assert got[900] == (None, None) and got[901][0] == 30_000 and got[902] == (None, None) and len(got) == len(events)


def test_context_digest_ignores_capture_and_order(spark):
    player = "array<struct<player_id: long, status: string>>"
    games = spark.createDataFrame([(1, "A", "B", "S"), (2, "C", "D", "S")], "game_pk long, home_team string, away_team string, feed_status string")
    moves = "transaction_id long, from_team string, to_team string, payload struct<kind: string>"

    def digests(rosters, transactions):
        rows = identity.context_fingerprint(games, spark.createDataFrame(rosters, f"team string, captured_at long, file_path string, players {player}"), spark.createDataFrame(transactions, moves), ["feed_status"])
        return {r["game_pk"]: r["fingerprint"] for r in rows.collect()}

    first = digests([("A", 1, "x", [(1, "ok"), (2, "il")]), ("C", 1, "x", [(9, "ok")])], [(7, "A", "B", ("trade",)), (8, "A", None, ("cut",))])
    again = digests([("A", 1, "x", [(3, "ok")]), ("A", 5, "y", [(2, "il"), (1, "ok")]), ("C", 9, "z", [(9, "ok")])], [(8, "A", None, ("cut",)), (7, "A", "B", ("trade",)), (7, "A", "B", ("trade",))])
    assert first == again
    moved = digests([("A", 1, "x", [(1, "ok"), (2, "ok")]), ("C", 1, "x", [(9, "ok")])], [(7, "A", "B", ("trade",)), (8, "A", None, ("cut",))])
    assert moved[1] != first[1] and moved[2] == first[2]
    traded = digests([("A", 1, "x", [(1, "ok"), (2, "il")]), ("C", 1, "x", [(9, "ok")])], [(7, "A", "C", ("trade",)), (8, "A", None, ("cut",))])
    assert traded[1] != first[1] and traded[2] != first[2]


def test_contracts_fitted_together_reach_the_optimum(spark):
    """Beside plain Newton steps in numpy, with a gap filled by the median and a constant feature."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1.0, 30.0, 0.1] + [5.0, 0.0, 1.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5)))).astype(int)
    rows = [(i, f"2024-{1 + i // 100:02d}-01", int(y[i]), *map(float, x[i]), 1.0) for i in range(400)]
    rows[7] = (*rows[7][:4], None, *rows[7][5:])
    frame = spark.createDataFrame(rows, "game_pk long, day string, a_win int, f0 double, f1 double, f2 double, f3 double").selectExpr("*", "cast(day as date) as game_date")
    contracts = {"all": ["f0", "f1", "f2", "f3"], "one": ["f1"]}
    predictions, facts = experiments.walk_forward(frame, ["f0", "f1", "f2", "f3"], [("w", "2024-04-01", "2024-04-30"), ("late", "2025-01-01", "2025-02-01")], contracts, 50)
    assert {(r["window"], r["candidate"], r["train_n"], r["features"]) for r in facts.collect()} == {("w", "all", 300, 4), ("w", "one", 300, 1)}
    got = {(r["candidate"], r["game_pk"]): r["probability"] for r in predictions.collect()}
    assert len(got) == 200
    z = np.column_stack([x, np.ones(400)])
    z[7, 1] = np.median(np.delete(x[:300, 1], 7))
    spread = z[:300].std(0)
    z = (z - z[:300].mean(0)) / np.where(spread > 0, spread, 1.0)
    for name, own in (("all", [0, 1, 2, 3]), ("one", [1])):
        design, beta = np.column_stack([np.ones(400), z[:, own]]), np.zeros(1 + len(own))
        penalty = np.diag([0.0] + [1 / 0.35] * len(own))
        for _ in range(30):
            p = 1 / (1 + np.exp(-design[:300] @ beta))
            beta -= np.linalg.solve((design[:300].T * (p * (1 - p))) @ design[:300] + penalty, design[:300].T @ (p - y[:300]) + penalty @ beta)
        want = 1 / (1 + np.exp(-design[300:] @ beta))
        assert max(abs(got[name, i] - want[i - 300]) for i in range(300, 400)) < 1e-6
    with pytest.raises(ValueError):
        experiments.walk_forward(frame, ["f0"], [("late", "2025-01-01", "2025-02-01")], {"one": ["f0"]}, 50)


def test_calibrator_is_the_penalised_fit(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    p = rng.random(300)
    y = (rng.random(300) < p).astype(int)
    fitted = ensemble.fit_calibrator(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "x double, y int"), "x", "y", 0.2)
    q = 1 / (1 + np.exp(-(fitted.intercept + fitted.slope * p)))
    assert abs((q - y).sum()) < 1e-6 and abs(((q - y) * p).sum() + fitted.slope / 0.2) < 1e-6


def test_bootstrap_equals_resamples_drawn_one_by_one(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    base, cand, y = np.round(rng.random(400), 2), np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    frame = spark.createDataFrame([(i, int(y[i]), float(base[i]), float(cand[i])) for i in range(400)], "pk long, y int, b double, c double").repartition(5)
    seeds = {r["pk"]: r["s"] for r in frame.select("pk", resampling.seed("pk").alias("s")).collect()}
    w = resampling.weights(np.array([seeds[i] for i in range(400)], np.int64).view(np.uint64), 50)
    assert abs(w[:, 1:].mean() - 1) < 0.05 and abs(w[:, 1:].var() - 1) < 0.1

    def auc(p, w):
        above = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        won, lost = w * (y == 1), w * (y == 0)
        return (won @ above @ lost) / (won.sum() * lost.sum())

    clip = lambda p: np.clip(p, 1e-6, 1 - 1e-6)
    deltas = {"brier": [], "auc": [], "accuracy": []}
    for k in range(51):
        v = w[:, k]
        deltas["brier"].append((v * ((clip(cand) - y) ** 2 - (clip(base) - y) ** 2)).sum() / v.sum())
        deltas["accuracy"].append((v * (((cand >= 0.5) == y).astype(int) - ((base >= 0.5) == y).astype(int))).sum() / v.sum())
        deltas["auc"].append(auc(cand, v) - auc(base, v))
    got = {r["metric"]: r for r in resampling.paired_bootstrap(frame, "y", "b", "c", "pk", 50).collect()}
    for name, values in deltas.items():
        assert got[name]["point"] == pytest.approx(values[0]) and got[name]["bootstrap_samples"] == 50
        assert got[name]["low"] == pytest.approx(np.quantile(values[1:], 0.025)) and got[name]["high"] == pytest.approx(np.quantile(values[1:], 0.975))
