"""Exact top-k search by MaxScore over integer vectors.

A query's terms are its dimensions; the posting of a term holds the component of every vector of a shard.
A component times the query's weight is the term's contribution; less the least contribution in the shard it is an
impact, never negative, and the term's spread is the greatest impact.  Against the query's threshold, the k-th best score
found so far, terms are split: the non-essential ones, of least spread, cannot together lift a vector to the threshold,
so only vectors in a posting of an essential term (an impact above 0 there) can be among the best.  Their essential
impacts are added up over the postings; the others are probed term by term, widest first, for the vectors that can
still reach the threshold, and each probe drops more.  What remains has its full score.

Vectors are dealt into shards of about ``SHARD`` by a hash, queries into blocks of ``QUERY_BLOCK``; each shard
meets each block in one task of bounded size, goes through its vectors in runs that raise the threshold, and only its k
best per query leave it.  The first shard is searched before the others, which begin with the thresholds it gave.
Shards merge by (score, smaller id).

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do null ids.  Vectors of different length are searched apart; empty ones score 0 with each other.  Equal
scores go to the smaller id.  A query's own row is that row alone: repeated rows of an id are candidates of each other,
and each query row is answered, so an id of two query rows has two lists.  Ids are cast to long.  Components of
any size are summed exactly; a score that passes 64 bits raises an error.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.llm.hard_negatives import EXACT, quantised, scores
from slatewise.session import stored

SHARD = 32768
QUERY_BLOCK = 2048
RUN = 4096  # vectors between two looks at the best so far
STEP = 4  # terms probed between two looks at the threshold


def _best(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~found))[:k]


class Shard:
    """Vectors of one shard and length with their postings, in runs."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.least, self.most = vectors.min(0), vectors.max(0)
        self.probes = 0  # components read, for tests

    def search(self, row: int, query: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best other rows that reach the threshold a query came with."""
        if float(np.abs(self.vectors).max(initial=0.0)) * float(np.abs(query).max(initial=0.0)) * max(len(query), 1) >= EXACT:
            found = scores(self.vectors, query)
            at = np.flatnonzero(self.rows != row)
            at = at[_best(self.ids[at], found[at], k)]
            return at, found[at]
        weights = query.astype(np.int64)
        low = np.minimum(weights * self.least.astype(np.int64), weights * self.most.astype(np.int64))
        spread = np.maximum(weights * self.least.astype(np.int64), weights * self.most.astype(np.int64)) - low
        terms = np.argsort(-spread, kind="stable")
        left = np.append(np.cumsum(spread[terms][::-1])[::-1], 0)  # most that terms from here on can add
        base = int(low.sum())
        at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(self.ids), RUN):
            some, found = self._run(a, weights, low, terms, left, base, threshold, row)
            at, best = np.append(at, some), np.append(best, found)
            pick = _best(self.ids[at], best, k)
            at, best = at[pick], best[pick]
            if len(at) == k:
                threshold = max(threshold, int(best[-1]))
        return at, best

    def _run(self, a: int, weights: np.ndarray, low: np.ndarray, terms: np.ndarray, left: np.ndarray, base: int, threshold: float, row: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.vectors[a : a + RUN]
        alive = np.flatnonzero(self.rows[a : a + RUN] != row)
        essential = int(np.searchsorted(-left, -(threshold - base), "right")) if np.isfinite(threshold) else len(terms)  # from there on, all together stay below the threshold
        score, listed = np.zeros(len(alive), np.int64), np.zeros(len(alive), bool)
        for term in terms[:essential]:
            impact = weights[term] * part[alive, term].astype(np.int64) - low[term]
            score += impact
            listed |= impact > 0
        self.probes += essential * len(alive)
        if essential < len(terms):
            alive, score = alive[listed], score[listed]
        for b in range(essential, len(terms), STEP):
            keep = score + base + left[b] >= threshold
            alive, score = alive[keep], score[keep]
            for term in terms[b : b + STEP]:
                score += weights[term] * part[alive, term].astype(np.int64) - low[term]
            self.probes += len(alive) * len(terms[b : b + STEP])
        keep = score + base >= threshold
        return a + alive[keep], score[keep] + base


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of every query row with the other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector_col)).alias("_ints"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    rows = stored(rows.where("_id is not null and _ints is not null").select(F.monotonically_increasing_id().alias("_row"), "_id", F.size("_ints").alias("_dims"), "_ints", "_asks"), "vectors")
    counted = rows.agg(F.count("*").alias("n"), F.count_if("_asks").alias("q")).first()
    n_shards, n_blocks = max(1, -(-counted["n"] // SHARD)), max(1, -(-counted["q"] // QUERY_BLOCK))
    dealt = lambda row, n: F.pmod(F.xxhash64(row), F.lit(n)).cast("int")
    held = rows.select("_row", "_id", "_dims", "_ints", dealt("_row", n_shards).alias("shard")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    asked = rows.where("_asks").select(F.col("_row").alias("row"), F.col("_id").alias("id"), F.col("_dims").alias("dims"), F.col("_ints").alias("ints"), dealt("_row", n_blocks).alias("block"))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dims = left["_dims"][0].as_py()
            matrix = left["_ints"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, dims)
            shard = Shard(left["_row"].to_numpy(), left["_id"].to_numpy(), matrix)
            for row, own, ints, threshold in zip(*(right[c].to_pylist() for c in ("row", "id", "ints", "threshold")), strict=True):
                at, found = shard.search(row, np.array(ints, np.float64), -np.inf if threshold is None else threshold, k)
                out += [(row, own, int(shard.rows[i]), int(shard.ids[i]), int(s)) for i, s in zip(at, found, strict=True)]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["row", "query_id", "found_row", "found", "score"])

    def search(shards: Column, queries: DataFrame) -> DataFrame:
        right = queries.groupBy("shard", "block", "dims")
        return held.where(shards).groupBy("shard", "block", "_dims").cogroup(right).applyInArrow(searched, "row long, query_id long, found_row long, found long, score long")

    first = stored(search(F.col("shard") == 0, asked.withColumns({"shard": F.lit(0), "threshold": F.lit(None).cast("long")})), "first-shard")
    partial = first
    if n_shards > 1:
        reached = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("threshold"))
        seeded = asked.join(reached, "row", "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(n_shards - 1))).alias("shard"))
        partial = first.unionByName(search(F.col("shard") > 0, seeded))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "found", "found_row"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")
