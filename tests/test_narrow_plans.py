"""Queries that carry only what they ask for."""

from pyspark.sql import functions as F

from slatewise.operators import ledger, snapshots
from slatewise.plans import context_queries, load_all
from slatewise.sources import documents
from slatewise.sources.adapters import Tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame, capsys) -> str:
    frame.explain()
    return capsys.readouterr().out


def test_votes_are_counted_before_any_shuffle(spark, capsys):
    votes = context_queries.context.component_counts(context_queries._components(Tables(spark, FOLDER)))
    plan = plan_of(votes, capsys)
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_issues_need_no_chain_of_digests(spark, capsys):
    plan = plan_of(load_all()["evidence_issues"].run(spark, FOLDER), capsys)
    assert "sha2(" not in plan and "lag(" not in plan


def test_a_capture_is_parsed_once(spark, capsys):
    payload = '{"stats":[{"splits":[{"stat":{"strikeOuts":"50","battersFaced":"200"}}]}]}'
    rows = [(1, "home", 7, payload, 25.0), (1, "away", 8, payload, 26.0), (2, "home", 9, "{}", None), (2, "away", 9, None, 3.0)]
    captures = spark.createDataFrame(rows, "game_pk long, side string, pitcher_id long, raw_payload string, starter_k_rate double").selectExpr(
        "*", "'starter_stats' as kind", "concat_ws(':', game_pk, side, pitcher_id) as identity", "sha2(raw_payload, 256) as raw_payload_sha256", "timestamp'2024-04-01' as captured_at", "timestamp'2024-04-02' as scheduled_start"
    )
    checked = snapshots.starter_snapshot_issues(captures)
    assert {(r.game_pk, r.side): r.issues for r in checked.collect()} == {(1, "home"): [], (1, "away"): ["metric"], (2, "home"): [], (2, "away"): ["metric"]}
    for frame in (documents.starter_identity_changes(checked.filter("size(issues) = 0")), snapshots.starter_snapshot_audit(captures)):
        capsys.readouterr()
        frame.explain("formatted")
        assert capsys.readouterr().out.count("from_json(") == 1


def test_a_chain_is_checked_where_its_events_lie(spark, capsys):
    events = Tables(spark, FOLDER).view("evidence")
    made = plan_of(events, capsys).count("Exchange")
    plan = plan_of(load_all()["hash_chain_verify"].run(spark, FOLDER), capsys)
    assert plan.count("Exchange") == made and "Join" not in plan


def test_a_chain_goes_on_across_spans(spark, monkeypatch):
    link = "sha2(concat('c', i, '|', coalesce(before, '')), 256)"
    rows, before = [], None
    for i in range(1, 8):
        own = spark.range(1).selectExpr(f"{i} as i", f"{repr(before) if before else 'cast(null as string)'} as before").selectExpr(link).first()[0]
        rows.append((5, i, "outcome", 1, before, own, f"c{i}"))
        before = own
    layout = "stream long, sequence long, event_type string, schema_version int, previous_event_sha256 string, event_sha256 string, content string"
    verdict = lambda kept: tuple(ledger.hash_chain_verify(spark.createDataFrame(kept, layout), F.col("content")).select("events", "first_break", "problem").first())
    gap, fork = [r for r in rows if r[1] != 4], [*rows, (5, 4, "outcome", 1, rows[2][5], "f" * 64, "other")]
    twice = [*rows[:6], (*rows[6][:5], rows[2][5], "c7")]
    plain = [verdict(k) for k in (rows, gap, fork, twice)]
    assert plain == [(7, None, None), (6, 5, "sequence_gap"), (8, 4, "repeated_sequence"), (7, 7, "duplicate_hash")]
    for span in (1, 2, 3):
        monkeypatch.setattr(ledger, "SPAN", span)
        assert [verdict(k) for k in (rows, gap, fork, twice)] == plain
