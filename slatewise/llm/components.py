"""Connected components of an edge table by local contraction.

Every task turns its edges into stars around the least node of each component it sees.  Edges that fit one task
are done then.  Otherwise every star edge goes to the tasks of both its ends, where stars that share a node merge, until
a round changes nothing; the number of tasks follows the number of edges.  Rounds are written to the shared
folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.session import stored

TASK_EDGES = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and the least node of each one's component."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_labels(*(np.concatenate([x, *(h[i] for h in held)]) for i, x in enumerate((u, v))))
        return least, nodes

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) > TASK_EDGES:
            u, v = merged()
            held = []
    u, v = merged()
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (u, v): comp is the smallest node that links reach."""
    edges = stored(edges.select("u", "v"), "edges")
    n = edges.count()
    if n <= TASK_EDGES:
        return stored(edges.coalesce(1).mapInArrow(_stars, "u long, v long"), "labels").select(F.col("v").alias("node"), F.col("u").alias("comp"))
    parts, before = -(-2 * n // TASK_EDGES), None
    while True:
        ends = edges.select(F.explode(F.array("u", "v")).alias("at"), "u", "v").distinct()
        stars = ends.repartition(parts, "at").select("u", "v").mapInArrow(_stars, "u long, v long").distinct()
        edges = stored(stars, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("comp"))
        before = now
