"""Sharding through a fixed number of virtual slots.

A record's hash decides its slot for good.  Bytes are summed per slot, and a versioned map says which
shard holds which slot.  Rebalancing edits the map: it moves as few slots as it can and writes the next
version, so records never need to be hashed again.  The map has one row per slot, whatever the data.

Slots are placed largest first on the lightest shard, so the shards get nearly the same number of bytes
(law ``bytes``).  Inside a shard rows are numbered without gaps: slot after slot, by id in each slot.

Defined results: null texts have no bytes; null ids are hashed like any value; repeated rows share a
slot and get positions of their own.  An empty table gives no rows, and its map spreads slots evenly.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions.literals import literal_rows
from holdfast.plans.store import TableStore

SLOTS = 4096
SHARDS = 24
RECORD_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot, by position."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def loads(self, sizes: Mapping[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += sizes.get(slot, 0)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return literal_rows(spark, rows, "version int, shards int, virtual_slot int, shard int")


def first_map(sizes: Mapping[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Places slots by falling size, each on the shard with the fewest bytes, then the fewest slots."""
    free = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        size, held, shard = heapq.heappop(free)
        shard_of[slot] = shard
        heapq.heappush(free, (size + sizes.get(slot, 0), held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalance(current: SlotMap, sizes: Mapping[int, int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """The next version of the map: slots leave dropped and overfull shards until none exceeds the mean by ``slack``.

    An overfull shard gives up its largest slots down to the mean, so few slots move; slots without
    bytes stay where they are.
    """
    shards = shards or current.shards
    shard_of = list(current.shard_of)
    total = sum(sizes.get(s, 0) for s in range(len(shard_of)))
    mean = total / shards
    loads = [0] * shards
    homeless = []
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            loads[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    for shard in range(shards):
        if loads[shard] <= mean * (1 + slack):
            continue
        for slot in sorted(held[shard], key=lambda s: (-sizes.get(s, 0), s)):
            size = sizes.get(slot, 0)
            if loads[shard] <= mean or not size:
                break
            if size <= loads[shard] - mean * (1 - slack):
                loads[shard] -= size
                homeless.append(slot)
    free = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(free)
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(free)
        shard_of[slot] = shard
        heapq.heappush(free, (load + sizes.get(slot, 0), shard))
    return SlotMap(current.version + 1, shards, tuple(shard_of))


def save_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Adds a version to the folder; earlier versions stay readable."""
    slot_map.frame(spark).coalesce(1).write.parquet(f"{folder}/version={slot_map.version}")


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slot_rows(df: DataFrame, doc_id: str, text: str, slots: int = SLOTS) -> DataFrame:
    """Narrow rows: doc_id, size, text_crc32, virtual_slot."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return df.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def place(rows: DataFrame, slot_map: SlotMap, counts: Mapping[int, int]) -> DataFrame:
    """Adds shard and slot, the position in the shard, to slot rows.

    Only rows of one slot are ordered together; the map gives the position of a slot's first row.
    """
    ahead = [0] * slot_map.shards
    starts = []
    for slot, shard in enumerate(slot_map.shard_of):
        starts.append((slot, shard, ahead[shard]))
        ahead[shard] += counts.get(slot, 0)
    lookup = literal_rows(rows.sparkSession, starts, "virtual_slot int, shard int, ahead bigint")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(lookup), "virtual_slot")  # one row per virtual slot, a fixed number
        .withColumn("slot", (F.col("ahead") + F.col("place") - 1).cast("bigint"))
        .drop("place", "ahead")
    )


def op6_virtual_slots(store: TableStore, documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = store.write("slot_rows", slot_rows(documents, "doc_id", "text", slots))
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    slot_map = first_map({r["virtual_slot"]: r["bytes"] for r in totals}, shards, slots)
    save_map(store.spark, slot_map, f"{store.root}/slot_map-{uuid.uuid4().hex[:8]}")
    return place(rows, slot_map, {r["virtual_slot"]: r["n"] for r in totals}).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )
