"""N-gram Jaccard join: exact self-join of documents on word-shingle sets with a prefix tree.

A document's set holds the 64-bit hashes of its distinct five-word shingles, in one global order (by hash).
Two documents link when 100 * intersection >= threshold * union.  The join loses no link:

1. *Sets.*  Documents with equal sets fold into one node.
2. *Filter.*  A set of n shingles must share one of its first floor(n/4)+1 in any global order.  A window of
   half as many more is cut from the hash order, document frequencies are counted inside the windows,
   and each set keeps the rarest part of its window that still must meet every partner: with W = window,
   partners share at least L = floor(n/8)+1 shingles inside the shorter window, so each may drop its partners' least L, less one, of the most
   frequent ones.
   Passages that many documents share are dropped there, before any group forms.
3. *Families.*  Sets that share kept shingles, directly or in steps, form families; links lie inside them.
4. *Trees.*  A family's sets go into a prefix tree: sets with a common beginning share its path.  A query
   walks the tree with its overlap so far, which all sets below share, and leaves a subtree when the shingles
   that remain, on either side, cannot reach the threshold, or when all of it is already connected to the query.
5. *Large families* are cut into blocks of ``BLOCK`` sets: blocks are searched by themselves, then one set of each
   component found meets the others, and at last every set outside the main component meets all others, block by
   block, or the sets of each kept shingle meet, whichever is less work.  The last step makes it exact.

Shuffles carry hashes as packed blobs, split by hash range into buckets whose number follows the data.  Texts
of candidate sets are fetched by a second scan, filtered by ids that are broadcast while they are few, which is
counted; beyond that texts are shuffled once.  A set is written with the block that it is searched in, so the first
round moves it once; later rounds read the sets of large families only.

Defined cases: null texts and texts without words have empty sets, link with nothing and are their own
component; texts of fewer than five words have one shingle.  Repeated rows are equal documents.  A null id is never
a component's name while another id is; a component of null ids only has a null name.  Extra columns are ignored.
Two different shingles of one pair of documents are confused with probability 2^-64 each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.components import components
from slatewise.llm.joins import small
from slatewise.llm.text import blocks, groups, mix64, shingle_sets
from slatewise.session import stored

THRESHOLD_PCT = 75
BLOCK = 1024  # sets of one tree
FLUSH = 3_000_000  # window shingles a task gathers before it writes blobs
ROWS_A_SET = 16  # rows that a set of a large family may send before the ways to search it are compared
BUCKET = 2_000_000  # window shingles of one bucket, about
WALK_CELLS = 4_000_000  # shingles times queries of one walk


def window_size(n: int) -> int:
    """Length of the window: prefix floor(n/4)+1 and half as many more."""
    return n // 4 + n // 8 + 1


def may_drop(n: int) -> int:
    """How many of its most frequent window shingles a set of n may drop: L-1 for its smallest partner."""
    return -(-n * THRESHOLD_PCT // 100) // 8


def node_of(values: np.ndarray, salt: int) -> int:
    """A set's name, an even number; odd ones are left for shingles."""
    return int(mix64(values ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) & ~1 if len(values) else 0


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s, 11) for s in sets], pa.int64()), pa.array([node_of(s, 29) for s in sets], pa.int64())],
                names=["_id", "_text_hash", "n", "node", "check"],
            )


def _windows(n_buckets: int):
    """Blobs of window shingles by bucket: low halves of the hashes, and which of the listed nodes each belongs to."""

    def packed(nodes: list[tuple[int, int]], windows: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(windows)
        owner = np.repeat(np.arange(len(nodes)), [len(w) for w in windows])
        bucket = ((tokens >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        low, owner = tokens[order].astype(np.uint32), owner[order]
        names, drops = np.array([n[0] for n in nodes], np.int64), np.minimum([n[1] for n in nodes], 65_535).astype(np.uint16)
        out = []
        for k in range(n_buckets):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                listed, place = np.unique(owner[a:b], return_inverse=True)
                out.append((k, low[a:b].tobytes(), place.astype(np.uint16).tobytes(), names[listed].tobytes(), drops[listed].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[i] for x in out], pa.binary()) for i in range(1, 5))], names=["bucket", "tokens", "place", "nodes", "drops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, windows, held, seen = [], [], 0, set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                for values in shingle_sets(data, offsets):
                    node = node_of(values, 11)
                    if len(values) and node not in seen:
                        seen.add(node)
                        nodes.append((node, may_drop(len(values))))
                        windows.append(values[: window_size(len(values))].copy())
                        held += len(windows[-1])
                if held >= FLUSH or len(nodes) > 60_000:
                    yield from _flush(nodes, windows, packed)
                    nodes, windows, held, seen = [], [], 0, set()
        yield from _flush(nodes, windows, packed)

    return run


def _flush(nodes: list[tuple[int, int]], windows: list[np.ndarray], packed) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(nodes), 60_000):
        yield packed(nodes[a : a + 60_000], windows[a : a + 60_000])


def _shared(n_parts: int):
    """Of one bucket, the shingles that two nodes or more hold, as blobs by part of the nodes."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        tokens, nodes, drops = [], [], []
        for part, place, listed, drop in zip(*(table[c].to_pylist() for c in ("tokens", "place", "nodes", "drops")), strict=True):
            at = np.frombuffer(place, np.uint16)
            tokens.append(np.frombuffer(part, np.uint32))
            nodes.append(np.frombuffer(listed, np.int64)[at])
            drops.append(np.frombuffer(drop, np.uint16)[at])
        # a node that several tasks met counts once: its first blob is kept
        first = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        token, node, drop = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(drops)
        del tokens, nodes, drops
        names, code = np.unique(node, return_inverse=True)
        least = np.full(len(names), len(first), np.int64)
        np.minimum.at(least, code, first)
        keep = first == least[code]
        token, node, drop = token[keep], node[keep], drop[keep]
        order = np.argsort(token, kind="stable")
        token, node, drop = token[order], node[order], drop[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        df = np.diff(np.append(starts, len(token)))
        each = np.repeat(df, df)
        pick = np.flatnonzero(each > 1)
        part = (mix64(node[pick].view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        pick = pick[order := np.argsort(part, kind="stable")]
        part = part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
        ends = np.append(cuts[1:], len(part)) if len(part) else cuts
        columns = (node[pick], drop[pick], each[pick].astype(np.uint32), token[pick])
        blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in columns]
        return pa.table([pa.array(part[cuts]), pa.array(np.full(len(cuts), bucket, np.int64)), *blobs], names=["part", "bucket", "nodes", "drops", "dfs", "tokens"])

    return run


def _kept(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(key, node): of every node of one part the shared window shingles that it keeps, the rarest."""
    columns = [np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("nodes", np.int64), ("drops", np.uint16), ("dfs", np.uint32), ("tokens", np.uint32))]
    node, drop, df, token = columns
    sizes = [len(x) // 4 for x in table["tokens"].to_pylist()]
    token = token.astype(np.int64) | np.repeat(np.array(table["bucket"].to_pylist(), np.int64) << 32, sizes)
    order = np.lexsort((token, df, node))
    node, drop, token = node[order], drop[order], token[order]
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
    count = np.diff(np.append(starts, len(node)))
    place = np.arange(len(node)) - np.repeat(starts, count)
    keep = place < np.repeat(count, count) - drop.astype(np.int64)
    keep &= np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])) if len(node) else keep
    return pa.table({"key": pa.array(token[keep]), "node": pa.array(node[keep])})


class PrefixTree:
    """Sets in one global order, as a tree of shared beginnings whose leaves are numbered in order."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            common[i] = differ.argmax() if differ.any() else n
        self.common = common
        #: (first leaf, end leaf, depth above, depth here, children)
        self.root = self._grown(0, len(sets), 0) if sets else None

    def _grown(self, lo: int, hi: int, above: int) -> list:
        root = [lo, hi, above, 0, []]
        todo = [root]
        while todo:
            node = todo.pop()
            lo, hi = node[0], node[1]
            node[3] = len(self.sets[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(self.common[lo + 1 : hi] == node[3]) + lo + 1).tolist(), hi]
                node[4] = [[a, b, node[3], 0, []] for a, b in zip(cuts, cuts[1:], strict=False)]
                todo += node[4]
        return root

    def search(self, queries: list[np.ndarray], leave: Callable[[int, int, np.ndarray], np.ndarray], pct: int = THRESHOLD_PCT) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries whose set reaches the threshold with it) in one walk for all queries.

        A path carries the overlaps of the queries that are still with it.  leave(first, end, queries) says which of
        them need not look at the leaves of a subtree.
        """
        sizes = np.array([len(q) for q in queries])
        if self.root is None or not len(queries):
            return
        listed = np.unique(np.concatenate(queries))
        holds = np.zeros((len(listed) + 1, len(queries)), np.uint8)  # the last row: shingles that no query has
        for i, q in enumerate(queries):
            holds[np.searchsorted(listed, q), i] = 1
        passed = np.zeros((len(listed) + 1, len(queries)), np.int32)  # shingles of a query among the first of the list
        np.cumsum(holds[:-1], 0, dtype=np.int32, out=passed[1:])
        todo = [(self.root, np.flatnonzero(sizes), np.zeros(int((sizes > 0).sum()), np.int64))]
        while todo:
            (lo, hi, depth, below, children), live, overlap = todo.pop()
            stay = ~leave(lo, hi, live)
            live, overlap = live[stay], overlap[stay]
            least, most = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
            path, step = self.sets[lo], 32
            while len(live) and depth < below:
                part = path[depth : min(below, depth + step)]
                at = np.searchsorted(listed, part)
                known = at[listed[np.minimum(at, len(listed) - 1)] == part]
                overlap = overlap + (holds[known][:, live] if len(live) > 16 else holds[np.ix_(known, live)]).sum(0, dtype=np.int64)
                depth += len(part)
                step *= 2
                a = sizes[live]
                rest = a - passed[np.searchsorted(listed, part[-1], "right")][live]
                size = np.clip(rest + depth, least, most)  # the size below that has most room
                alive = (100 + pct) * (overlap + np.minimum(size - depth, rest)) >= pct * (a + size)
                live, overlap = live[alive], overlap[alive]
            if not len(live):
                continue
            if hi - lo == 1:
                reached = (100 + pct) * overlap >= pct * (sizes[live] + len(path))
                if reached.any():
                    yield lo, live[reached]
            else:
                todo += [(child, live, overlap) for child in children]


def tree_links(nodes: list[int], sets: list[np.ndarray], comps: list[int], sides: list[int]) -> list[tuple[int, int]]:
    """A spanning star of every component found: all pairs of one side, or of two sides the pairs across."""
    asking = [i for i, s in enumerate(sides) if s == max(sides)]
    tree = PrefixTree([sets[i] for i in range(len(sets)) if len(set(sides)) == 1 or sides[i] != max(sides)])
    held = [i for i in range(len(sets)) if len(set(sides)) == 1 or sides[i] != max(sides)]
    leaves = np.array([held[i] for i in tree.order])
    comp = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
    before = comp.copy()
    start = 0
    while start < len(asking):
        # as many queries as keep the tables of one walk small
        end, total = start, 0
        while end < len(asking) and (end == start or (total + len(sets[asking[end]])) * (end + 1 - start) <= WALK_CELLS):
            total += len(sets[asking[end]])
            end += 1
        mine = np.array(asking[start:end])
        start = end

        def settled(lo: int, hi: int, live: np.ndarray, mine: np.ndarray = mine) -> np.ndarray:
            below = comp[leaves[lo:hi]]
            return comp[mine[live]] == below[0] if (below == below[0]).all() else np.zeros(len(live), bool)

        for leaf, found in tree.search([sets[i] for i in mine], settled):
            joined = np.unique(np.append(comp[mine[found]], comp[leaves[leaf]]))
            comp[np.isin(comp, joined[1:])] = joined[0]
    out = []
    for c in np.unique(comp[comp != before]):
        heads = {int(before[m]): nodes[m] for m in np.flatnonzero(comp == c).tolist()}  # one node of each earlier component is enough
        least = min(heads.values())
        out += [(least, v) for v in heads.values() if v != least]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for _, table in groups(batches, "group"):
        rows = {}  # repeated rows of a node count once
        for node, comp, side, packed in zip(*(table[c].to_pylist() for c in ("node", "comp", "side", "packed")), strict=True):
            rows[node] = (comp, side, np.frombuffer(packed, np.uint64))
        if len(rows) > 1:
            for a, b in tree_links(list(rows), [r[2] for r in rows.values()], [r[0] for r in rows.values()], [r[1] for r in rows.values()]):
                u.append(a)
                v.append(b)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _distinct_lists(members: DataFrame) -> DataFrame:
    """(key, node) without keys whose members equal another key's, and without keys of one member."""
    signed = members.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("t"), F.count("*").alias("m")).where("m > 1")
    return members.join(signed.groupBy("s", "t", "m").agg(F.min("key").alias("key")).select("key"), "key")


def _blocks_of(size: Column) -> Column:
    return F.ceil(size / BLOCK)


def _block(salt: int, count: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))


def _links(grouped: DataFrame) -> DataFrame:
    """Links inside the groups (group, node, comp, side, packed)."""
    return grouped.select("group", "node", "comp", "side", "packed").repartition("group").sortWithinPartitions("group").mapInArrow(_linked, "u long, v long")


def _all_pairs(members: DataFrame) -> DataFrame:
    """Groups in which all members of each key meet: one for each pair of the key's blocks."""
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("m")), "key").withColumn("n_blocks", _blocks_of(F.col("m"))).withColumn("own", _block(7, "n_blocks"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return met.select("node", "comp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), F.col("own").cast("int").alias("side"))


def _across(members: DataFrame) -> DataFrame:
    """Groups in which every member outside its family's largest component meets all members of other blocks.

    Those of its own block it met in the first round; asking there too, it would be in one group on both sides.
    """
    comps = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = comps.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("most")).select("key", "m", F.col("most.comp").alias("main"), (F.col("m") - F.col("most.n")).alias("rest")).where("rest > 0")
    marked = members.join(largest, "key").withColumn("n_blocks", _blocks_of(F.col("m"))).withColumn("n_rest", _blocks_of(F.col("rest")))
    held = marked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1))).select("key", "i", _block(7, "n_blocks").alias("j"), "node", "comp", F.lit(0).alias("side"))
    asks = marked.where("comp <> main").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).where(F.col("j") != _block(7, "n_blocks")).select("key", _block(9, "n_rest").alias("i"), "j", "node", "comp", F.lit(1).alias("side"))
    return held.union(asks).select(F.xxhash64("key", "i", "j").alias("group"), "node", "comp", "side")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with the component that the edges so far give their node."""
    if edges.isEmpty():
        return members.withColumn("comp", F.col("node"))
    return members.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def link_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    named = _named(documents, id_col, text_col)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("_id").alias("component_id"))
    full = named.join(least, "comp").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = named.where("n = 0").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    return full.union(empty)


def _named(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text_hash, n, comp) of every row; comp names the component, null for an empty set."""
    texts = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_text_hash"))
    prints = stored(texts.mapInArrow(_prints, "_id long, _text_hash long, n long, node long, check long"), "prints")
    labels = _labels(texts, prints)
    full = prints.where("n > 0")
    full = full.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if labels is not None else full.withColumn("comp", F.col("node"))
    empty = prints.where("n = 0").withColumn("comp", F.lit(None).cast("long"))
    return stored(full.select("_id", "_text_hash", "n", "comp").union(empty.select("_id", "_text_hash", "n", "comp")), "named")


def _labels(texts: DataFrame, prints: DataFrame) -> DataFrame | None:
    """(node, comp) of linked nodes, None without links."""
    full = prints.where("n > 0")
    total = full.agg(F.sum(F.floor(F.col("n") / 4) + F.floor(F.col("n") / 8) + 1)).first()[0] or 0
    n_buckets = max(1, -(-int(total) // BUCKET))
    blobs = texts.select("_text").mapInArrow(_windows(n_buckets), "bucket long, tokens binary, place binary, nodes binary, drops binary")
    shared = blobs.groupBy("bucket").applyInArrow(_shared(max(1, n_buckets // 4)), "part long, bucket long, nodes binary, drops binary, dfs binary, tokens binary")
    kept = stored(shared.groupBy("part").applyInArrow(_kept, "key long, node long"), "kept")
    nodes = full.groupBy("node").agg(F.min(F.struct("_id", "_text_hash")).alias("_row"))
    lists = stored(_distinct_lists(kept), "lists")
    # sets and shingles are the nodes, even and odd, of one graph
    families = components(lists.select(F.xxhash64("key").bitwiseOR(F.lit(1)).alias("u"), F.col("node").alias("v")))
    members = stored(families.where("node % 2 = 0").select(F.col("comp").alias("key"), "node"), "families")
    blocked = members.join(members.groupBy("key").agg(_blocks_of(F.count("*")).alias("n_blocks")), "key").select("key", "node", (F.col("n_blocks") > 1).alias("large"), F.xxhash64("key", _block(7, "n_blocks")).alias("group"))
    wanted = stored(nodes.join(blocked, "node").select(F.col("_row._id").alias("r_id"), F.col("_row._text_hash").alias("r_hash"), "group", "large"), "wanted")
    picked = texts.join(small(wanted), texts["_id"].eqNullSafe(F.col("r_id")) & (F.col("_text_hash") == F.col("r_hash")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                sets = shingle_sets(data, offsets)
                carried = [batch.column(i).slice(a, b - a) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s, 11) for s in sets], pa.int64()), *carried, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "group", "large", "packed"])

    sets = stored(picked.select("_text", "group", "large").mapInArrow(packed, "node long, group long, large boolean, packed binary"), "sets")
    return _rounds(lists, blocked, sets)


def _rounds(lists: DataFrame, blocked: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, comp) of linked nodes: blocks of families, then joined blocks, then what is still apart."""
    edges = stored(_links(sets.withColumns({"comp": F.col("node"), "side": F.lit(0)})), "links")
    large = stored(blocked.where("large").select("key", "node"), "large")
    sets = sets.where("large").select("node", "packed")
    if not large.isEmpty():
        # one node of each component of several meets the others' of its family
        joined = _labelled(large, edges).groupBy("key", "comp").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n > 1").select("key", "node", "comp")
        edges = edges.union(stored(_links(_all_pairs(joined).join(sets, "node")), "links"))
        apart = stored(_labelled(large, edges), "apart")
        # two exact ways for each family: all against those outside the main component, or by kept shingle where that is less
        comps = apart.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max("n").alias("most"))
        rest = F.col("m") - F.col("most")
        costs = stored(comps.where(rest > 0).select("key", "m", (F.col("m") * _blocks_of(rest) + rest * _blocks_of(F.col("m"))).alias("cost")), "costs")
        last = _across(apart.join(costs.where(F.col("cost") <= ROWS_A_SET * F.col("m")).select("key"), "key"))
        dear = costs.where(F.col("cost") > ROWS_A_SET * F.col("m"))
        if not dear.isEmpty():
            by_list = lists.join(apart.join(dear.select("key"), "key").select(F.col("key").alias("family"), "node", "comp"), "node")
            listed = by_list.groupBy("family", "key").agg(F.count("*").alias("n")).groupBy(F.col("family").alias("key")).agg(F.sum(F.col("n") * _blocks_of(F.col("n"))).alias("listed"))
            choice = stored(dear.join(listed, "key").select("key", (F.col("cost") <= F.col("listed")).alias("whole")), "choice")
            last = last.unionByName(_across(apart.join(choice.where("whole").select("key"), "key")))
            last = last.unionByName(_all_pairs(by_list.join(choice.where("not whole").select(F.col("key").alias("family")), "family").select("key", "node", "comp")))
        edges = edges.union(stored(_links(last.join(sets, "node")), "links"))
    return None if edges.isEmpty() else components(edges)


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without those that link, directly or in steps, to another that stays; all columns kept.

    Of each component the row of the smallest id stays, of several texts of that id one, and besides it one row
    of those without an id.  Decisions hold for an id with its text, so other texts of the same id are untouched.
    Rows of one id and one text are one document; rows without an id and without words all stay.
    The documents' columns may have any names: they travel as one struct.
    """
    named = _named(documents, id_col, text_col)
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash"))
    document = F.struct("_id", "_text_hash")
    full = named.where("comp is not null").withColumn("nameless", F.col("_id").isNull())
    # written, so that the rows of a component of many need not meet in one task
    stays = stored(full.groupBy("comp", "nameless").agg(F.min(document).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n"), "stays")
    linked = full.join(small(stays), ["comp", "nameless"]).where(~document.eqNullSafe(F.col("stays")))
    gone = stored(linked.select(F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash")).distinct(), "gone")
    counted = named.where("_id is not null or n > 0").groupBy("_id", "_text_hash").count().where("`count` > 1")
    repeated = stored(counted.join(small(gone), same, "left_anti").select(F.col("_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash")), "repeated")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    marked = whole.withColumns({"_id": F.col("_row")[id_col].cast("long"), "_text_hash": F.xxhash64(F.col("_row")[text_col])})
    kept = marked.join(small(gone), same, "left_anti")
    if not repeated.isEmpty():
        listed = small(repeated)
        kept = kept.join(listed, same, "left_anti").union(marked.join(listed, same, "left_semi").dropDuplicates(["_id", "_text_hash"]))
    return kept.select("_row.*")
