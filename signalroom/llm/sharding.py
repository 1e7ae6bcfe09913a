"""Sharding by fixed virtual slots.

A record hashes, by its id and text, to one of thousands of virtual slots and never changes it. Bytes are summed per
slot, and a small versioned map says which shard holds which slot. Rebalancing or growing edits
the map; a record moves only when its slot moves.

Driver memory: the map and the byte sums have ``slots`` rows, whatever the input has.

Cases: a null text counts as no bytes (size 1, crc32 of nothing, 0); empty and long texts are
ordinary; equal texts and repeated rows each get a place of their own, ties in the order within a
slot fall to size and crc; records of one doc_id, or of none, spread by their texts, and only rows that
repeat both share a slot; an empty table gives no rows;
further columns of the input are not carried, so none can clash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 8192
SHARDS = 16


def measure(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.crc32(data)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(measured: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot: at most one row for each slot reaches the driver."""
    rows = measured.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    return {r["virtual_slot"]: r["bytes"] for r in rows}


def plan_map(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The first map: the largest slot goes to the lightest shard, and so on; ties to the smaller number."""
    owner = [0] * slots
    heap = [(0, 0, shard) for shard in range(shards)]
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), held + 1, shard))
    return owner


def rebalance(owner: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """An edited map for ``shards`` shards: slots leave only shards above the mean, for the lightest one."""
    owner = list(owner)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(owner):
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(sizes.values()) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes.get(s, 0), s)):
            if load[shard] - sizes.get(slot, 0) >= mean and sizes.get(slot, 0):
                load[shard] -= sizes[slot]
                homeless.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-sizes.get(s, 0), s)):
        bytes_, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (bytes_ + sizes.get(slot, 0), shard))
    return owner


def store_map(spark: SparkSession, owner: list[int], version: int, path: str) -> DataFrame:
    """Writes version ``version`` of the map below path and returns it: virtual_slot, shard, map_version."""
    rows = spark.range(len(owner)).select(
        F.col("id").cast("int").alias("virtual_slot"),
        F.get(common.int_array(owner), F.col("id").cast("int")).alias("shard"),
        F.lit(version).alias("map_version"),
    )
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")
    return spark.read.parquet(f"{path}/version={version:06d}")


def place(measured: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds shard, map_version and slot, the record's place in its shard, gapless from 0.

    Places are dealt within virtual slots and shifted by what the shard's earlier slots hold, so no
    task sees a whole shard. ``owners`` has one row for each virtual slot, which bounds the broadcast.
    """
    counts = measured.groupBy("virtual_slot").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        owners.join(F.broadcast(counts), "virtual_slot", "left")
        .select("virtual_slot", "shard", "map_version", F.coalesce(F.sum(F.coalesce("held", F.lit(0))).over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (
        measured.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("place"))
        .drop("first", "place")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Measures, plans, stores version 1 of the map and places every record."""
    spark = docs.sparkSession
    measured = common.materialize(measure(docs, slots), "shard-sizes")
    owner = plan_map(slot_bytes(measured), shards, slots)
    return place(measured, store_map(spark, owner, 1, common.new_path(spark, "shard-map")))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[int], int]:
    """The shard of each slot in a version of the map below path, the last one by default, and that version."""
    maps = spark.read.option("basePath", path).parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    rows = maps.where(F.col("version") == version).select("virtual_slot", "shard").orderBy("virtual_slot").collect()
    return [r["shard"] for r in rows], version


def reshard(measured: DataFrame, path: str, shards: int) -> DataFrame:
    """Edits the last version of the map below path for measured records and so many shards, stores it as the next, and places the records."""
    owner, version = read_map(measured.sparkSession, path)
    return place(measured, store_map(measured.sparkSession, rebalance(owner, slot_bytes(measured), shards), version + 1, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(common.table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
