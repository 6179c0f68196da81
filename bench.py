"""Time headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from slatewise.plans import load_all
from slatewise.session import local_session
from slatewise.sources.adapters import VIEWS, Tables

HEADLINES = (
    "season_strength",
    "rolling_form",
    "ewm_form",
    "opponent_adjusted_form",
    "matchup_features",
    "strength_calibration",
    "matched_validation",
    "probability_metrics",
    "subgroup_metrics",
    "paired_bootstrap",
    "latest_per_key",
    "provider_snapshot_diff",
    "price_quotes_from_draws",
    "quote_valuation",
    "rank_best_value",
    "score_summary",
    "settle_predictions",
    "hash_chain_verify",
    "evidence_audit",
    "nearest_event_match",
    "schedule_dedupe_merge",
    "pitching_context_rows",
    "closer_availability",
    "batter_pitcher_matchup",
    "series_policy",
    "slate_evaluation",
    "stream_current_quotes",
    "stream_line_moves",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry = load_all()
    names = sys.argv[1:] or [n for n in HEADLINES if n in registry]
    tables = Tables(spark, folder)
    start = time.time()
    for view in VIEWS:
        tables.path(view)
    setup = round(time.time() - start, 3)  # writing the domain tables, shared by all queries and part of the total
    timings = {}
    for name in names:
        start = time.time()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    total = round(setup + sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "domain_tables_sec": setup, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
