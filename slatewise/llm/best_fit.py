"""Best-fit packing under conflicts: documents fill training sequences of a fixed number of words.

No bin holds two pieces of one source or of one duplicate cluster (documents of equal words, or the classes of
a given column).  Documents longer than the capacity are cut into pieces; whole texts are placed.

Pieces are dealt evenly into packing groups by a hash of id and piece, so that a hot source or cluster
spreads over all groups; each group, some ``GROUP_ROWS`` documents large at any input size, is packed by
itself in one task.  Pieces come in falling size.  Bins are kept in order of their residual; each carries a
bitmap of its sources and one of its duplicate clusters.  The search starts at the least residual that holds
the piece and goes on to the successor until a bin is compatible; levels whose bins all hold the source are
passed over by a count.  Of equal residuals the bin that reached it first wins; without a compatible bin a new one
opens.

Defined cases: documents without words (null or empty texts) are not packed: part 0, null bin.  A null source
is a source.  Repeated rows are pieces of one duplicate cluster.  Ties in size go by id and part.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.decontaminate import word_list

CAPACITY = 2048
GROUP_ROWS = 8192
GROUP_SPAN = 1 << 32


class Bins:
    """Open bins in order of residual, each with its bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: dict[int, dict[int, None]] = defaultdict(dict)  # residual -> bins, in the order they reached it
        self.filled = 0  # bit r: some bin has residual r
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.holding: dict[tuple[int, int], int] = defaultdict(int)  # (source, residual) -> bins

    def place(self, size: int, source: int, cluster: int | None) -> tuple[int, int]:
        """(bin, start) for a piece; source and cluster are bit numbers, None for a cluster of one."""
        mark, copies = 1 << source, 0 if cluster is None else 1 << cluster
        at = self._found(size, source, mark, copies)
        if at is None:
            at = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._leave(at)
        start = self.capacity - self.residual[at]
        self.residual[at] -= size
        self.sources[at] |= mark
        self.clusters[at] |= copies
        if self.residual[at]:
            self._enter(at)
        return at, start

    def _found(self, size: int, source: int, mark: int, copies: int) -> int | None:
        above = self.filled >> size
        while above:
            step = (above & -above).bit_length() - 1
            level = size + step
            if self.holding.get((source, level), 0) < len(self.levels[level]):
                for at in self.levels[level]:
                    if not self.sources[at] & mark and not self.clusters[at] & copies:
                        return at
            above &= above - 1
        return None

    def _bits(self, mask: int) -> Iterable[int]:
        while mask:
            yield (mask & -mask).bit_length() - 1
            mask &= mask - 1

    def _leave(self, at: int) -> None:
        level = self.residual[at]
        del self.levels[level][at]
        if not self.levels[level]:
            self.filled &= ~(1 << level)
        for source in self._bits(self.sources[at]):
            self.holding[source, level] -= 1

    def _enter(self, at: int) -> None:
        level = self.residual[at]
        self.levels[level][at] = None
        self.filled |= 1 << level
        for source in self._bits(self.sources[at]):
            self.holding[source, level] += 1


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and starts of one group's pieces (_id, part, size, _source, _cluster)."""
    pieces = pieces.sort_values(["size", "_id", "part"], ascending=[False, True, True], kind="stable", na_position="first")
    sources = pd.factorize(pieces["_source"], use_na_sentinel=False)[0]
    codes = pd.factorize(pieces["_cluster"])[0]
    counts = pd.Series(codes).groupby(codes).transform("size").to_numpy()
    shared = pd.factorize(pd.Series(codes).where(counts > 1))[0]  # -1: a cluster of one
    bins = Bins(capacity)
    placed = [bins.place(size, source, cluster if cluster >= 0 else None) for size, source, cluster in zip(pieces["size"].tolist(), sources.tolist(), shared.tolist(), strict=True)]
    return pieces.assign(_bin=[p[0] for p in placed], start=[p[1] for p in placed])


def pack(documents: DataFrame, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(id, part, n_parts, first_word, size, bin_id, start): where each piece of each document lies."""
    n_groups = max(1, -(-documents.count() // GROUP_ROWS))
    listed = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), word_list(F.col(text_col)).alias("_words"), *([F.col(cluster_col).alias("_given")] if cluster_col else []))
    cluster = F.xxhash64("_given") if cluster_col else F.xxhash64(F.concat_ws(" ", "_words"))
    sized = listed.select("_id", "_source", cluster.alias("_cluster"), F.size("_words").alias("_total")).withColumn("n_parts", F.greatest(F.ceil(F.col("_total") / capacity), F.lit(1)).cast("int"))
    pieces = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).withColumn("size", F.least(F.lit(capacity), F.col("_total") - F.col("part") * capacity))
    grouped = pieces.where("size > 0").withColumn("_group", F.pmod(F.xxhash64("_id", "part", "_cluster"), F.lit(n_groups)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(pdf, capacity)
        out["bin_id"] = out["_group"] * GROUP_SPAN + out["_bin"]
        return out[["_id", "part", "n_parts", "size", "bin_id", "start"]]

    placed = grouped.groupBy("_group").applyInPandas(packed, "_id long, part int, n_parts int, size int, bin_id long, start int")
    empty = pieces.where("size = 0").select("_id", "part", "n_parts", "size", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("start"))
    return placed.union(empty).select(F.col("_id").alias(id_col), "part", "n_parts", (F.col("part") * capacity).alias("first_word"), "size", "bin_id", "start")
