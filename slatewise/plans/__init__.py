"""Registered queries, one module per subject."""

from importlib import import_module

from slatewise.plans.registry import REGISTRY, Query

SUBJECTS = ("history_queries", "metric_queries", "market_queries", "ledger_queries", "identity_queries", "pitching_queries", "context_queries", "source_queries", "learner_queries")


def load_all() -> dict[str, Query]:
    for subject in SUBJECTS:
        import_module(f"{__name__}.{subject}")
    return REGISTRY
