"""Joins against tables of ids that are mostly small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 500_000  # rows of one or two numbers each: a few tens of MB at most


def small(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """`ids` marked for broadcast where its counted rows are within the bound; beyond it Spark shuffles both sides.

    Give it a written table: counting evaluates it.
    """
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids
