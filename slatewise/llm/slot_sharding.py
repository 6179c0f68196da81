"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into ``SLOTS`` virtual slots, a number that never changes.  Bytes are summed per slot; the map
from slots to shards is dealt so that shard sizes are near equal (the `bytes` law): slots in falling size, each
to the lightest shard.  Rebalancing edits the last version of the map, moving no more slots than it must, and
writes the next version; records never move between slots, so a new version moves whole slots only.

A record's slot comes from the hash of id, text checksum and size, so that an id that many different records
share spreads as well; of repeated rows, which no hash of theirs tells apart, also from their place in a written table.  Only slot totals, ``SLOTS`` rows at any input size, reach the driver.  A record's place in
its shard is the number of records in the shard's earlier virtual slots plus its rank in its own.  Texts
are never shuffled.

Defined cases: a null text has no bytes and size 1, with the checksum of an empty text; null ids and repeated
rows are records like others; which of equal rows has which place is of no account.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.joins import small
from slatewise.session import stored, work_path

SLOTS = 8192
SHARDS = 16
LAW = "bytes"
MAP_SCHEMA = "version int, virtual_slot long, shard int, slot_bytes long, slot_rows long"


def deal(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The first map: slots in falling size, each to the lightest shard (ties: lower shard)."""
    loads = [(0, shard) for shard in range(shards)]
    out = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[slot] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def edit(current: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next map: slots leave shards that are gone or over the mean by `tolerance`, for the lightest shard.

    From an overfull shard goes the largest slot that does not make the receiver heavier than the giver was.
    """
    loads = [0] * shards
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    homeless = []
    for slot, size in sizes.items():
        shard = current.get(slot)
        if shard is None or shard >= shards:
            homeless.append((slot, size))
        else:
            loads[shard] += size
            held[shard][slot] = size
    out = {slot: current[slot] for shard in held for slot in shard}
    for slot, size in sorted(homeless, key=lambda x: (-x[1], x[0])):
        to = min(range(shards), key=lambda s: (loads[s], s))
        out[slot], held[to][slot] = to, size
        loads[to] += size
    limit = sum(loads) / shards * (1 + tolerance)
    while True:
        giver, taker = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[giver] - loads[taker]
        fits = [(size, -slot) for slot, size in held[giver].items() if 0 < size < gap]
        if loads[giver] <= limit or not fits:
            return out
        half = [x for x in fits if x[0] <= gap / 2] or [min(fits)]
        size, slot = max(half)
        out[-slot], held[taker][-slot] = taker, size
        del held[giver][-slot]
        loads[giver] -= size
        loads[taker] += size


class SlotMap:
    """Versions of the slot-to-shard map in a folder, one Parquet folder a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version}")

    def write(self, version: int, placed: dict[int, int], totals: dict[int, tuple[int, int]]) -> DataFrame:
        rows = [(version, slot, placed[slot], *totals[slot]) for slot in sorted(placed)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return self.read(version)

    def create(self, records: DataFrame, shards: int) -> DataFrame:
        totals = slot_totals(records)
        return self.write(1, deal({s: b for s, (b, _) in totals.items()}, shards), totals)

    def rebalance(self, version: int, records: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
        """Version + 1, edited from `version` for the records of today and the wanted number of shards."""
        totals = slot_totals(records)
        current = {r["virtual_slot"]: r["shard"] for r in self.read(version).collect()}
        return self.write(version + 1, edit(current, {s: b for s, (b, _) in totals.items()}, shards, tolerance), totals)


def records_of(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every record; repeated rows spread over the slots by their place in a written table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = documents.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(measured.withColumn("_row", F.monotonically_increasing_id()), "records")
    twice = rows.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    twice = stored(twice.select(F.col("_id").alias("_same_id"), F.col("size").alias("_same_size"), F.col("text_crc32").alias("_same_crc32")), "repeated")
    same = F.col("_id").eqNullSafe(F.col("_same_id")) & (F.col("size") == F.col("_same_size")) & (F.col("text_crc32") == F.col("_same_crc32"))
    marked = rows.join(small(twice), same, "left")
    copy = F.when(F.col("_same_size").isNotNull(), F.col("_row"))  # a null leaves the hash as it is
    return marked.select("_id", "size", "text_crc32", F.pmod(F.xxhash64("_id", "text_crc32", "size", copy), F.lit(slots)).alias("virtual_slot"))


def slot_totals(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by virtual slot, one entry per slot at most."""
    return {r[0]: (r[1], r[2]) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def shard_records(spark: SparkSession, documents: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every record.

    `slot` is the place in the shard, without gaps from 0.
    """
    records = stored(records_of(documents, id_col=id_col, text_col=text_col, slots=slots), "placed")
    mapping = SlotMap(spark, map_path or work_path(spark, "slot-map")).create(records, shards)
    # one row per virtual slot: what lies before it in its shard
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mapping.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("_before"), F.col("version").alias("map_version"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("_id", "text_crc32", "size"))
    ranked = records.withColumn("_rank", rank)
    return ranked.join(F.broadcast(offsets), "virtual_slot").select(  # SLOTS rows at most
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
