"""Sharding by fixed virtual slots.

A record's key hashes to one of a few thousand slots and never leaves it. Slots are dealt to shards by
a map with versions; rebalancing or growing edits the map, so only the moved slots' rows move. All
tables but the records hold one row a slot, so they are bounded by the slot count.

Rows: null keys hash by their text; null texts have no bytes; rows of one key share a slot, but for a slot
with more than a PARTS-th of a shard's mean bytes: it is dealt out by row into sub-slots, which the map holds
like other slots, so that a key with a third of all rows leaves the sizes near equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

SLOTS, PARTS = 4096, 16
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def slot_of(key: Column, text: Column, slots: int) -> Column:
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.crc32(text).cast("string")))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_stats(records: DataFrame, spark: SparkSession, slots: int) -> DataFrame:
    """One row a slot, empty ones and sub-slots too: virtual_slot, slot_bytes, slot_rows."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "full").fillna(0, ["slot_bytes", "slot_rows"])


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt in turn."""
    return stats.select(F.lit(0).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"))


def _refill(kept: DataFrame, pool: DataFrame, shards: int) -> DataFrame:
    """Deals the pool's slots, largest first, each to the shard with the fewest bytes so far."""
    every = pool.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = (
        every.join(kept.groupBy("shard").agg(F.sum("slot_bytes").alias("load")), "shard", "left")
        .agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))).alias("l"))
        .select(F.transform("l", lambda x: x["load"].cast("long")).alias("loads"))
    )
    queue = pool.agg(F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("minus"), "virtual_slot"))).alias("queue"))

    def deal(acc: Column, x: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"]))
        return F.struct(
            F.transform(acc["loads"], lambda load, i: load - F.when(i == at - 1, x["minus"]).otherwise(F.lit(0))).alias("loads"),
            F.concat(acc["dealt"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), (at - 1).cast("int").alias("shard")))).alias("dealt"),
        )

    none = F.expr("cast(array() as array<struct<virtual_slot:int,shard:int>>)")
    dealt = queue.crossJoin(loads).select(F.aggregate("queue", F.struct(F.col("loads").alias("loads"), none.alias("dealt")), deal)["dealt"].alias("d"))
    return kept.select("virtual_slot", "shard").unionByName(dealt.select(F.inline("d")))


def rebalanced(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: shards keep slots up to the mean load, the rest is dealt anew."""
    mean = F.sum("slot_bytes").over(Window.partitionBy()) / F.lit(shards)
    own = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot")
    at = old.join(stats, "virtual_slot").withColumn("over", F.sum("slot_bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)) > mean)
    new = _refill(at.filter(~F.col("over")), at.filter("over"), shards)
    return new.crossJoin(old.agg((F.max("version") + 1).alias("version"))).select("version", "virtual_slot", "shard")


def grown(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more, numbered `shards`: each donor gives what it has over the new mean."""
    target = F.sum("slot_bytes").over(Window.partitionBy()) / F.lit(shards + 1)
    load = F.sum("slot_bytes").over(Window.partitionBy("shard"))
    own = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    at = old.join(stats, "virtual_slot").withColumn("give", F.sum("slot_bytes").over(own) <= load - target)
    return at.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("give"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def latest(maps: DataFrame) -> DataFrame:
    newest = maps.agg(F.max("version").alias("version"))
    return maps.join(F.broadcast(newest), "version")


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(F.col("doc_id"), text, slots).alias("virtual_slot"),
    )


def _parted(records: DataFrame, stats: DataFrame, shards: int, slots: int) -> DataFrame:
    """records with the sub-slots of large slots: number slot + slots * part. records is a table, so a row's deal stays."""
    total = stats.agg(F.sum("slot_bytes").alias("total"))
    share = F.ceil(F.col("slot_bytes") * F.lit(shards * PARTS) / F.nullif(F.col("total"), F.lit(0))).cast("int").alias("parts")
    large = stats.crossJoin(total).select("virtual_slot", share).filter("parts > 1")  # at most shards * PARTS rows
    part = F.pmod(F.col("deal"), F.coalesce("parts", F.lit(1))).cast("int")
    return records.join(F.broadcast(large), "virtual_slot", "left").withColumn("virtual_slot", F.col("virtual_slot") + F.lit(slots) * part).drop("parts", "deal")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, maps: DataFrame | None = None) -> DataFrame:
    """Puts every row of docs (doc_id, text) in a shard with near equal bytes.

    maps: earlier versions of the map (version, virtual_slot, shard), else version 0 is dealt in turn.
    Returns doc_id, size, text_crc32, virtual_slot, map_version, shard, slot (place in the shard, from 0).
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    records = written(records_of(docs, slots).withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id())), "shard-records")
    records = _parted(records, slot_stats(records, spark, slots), shards, slots)
    stats = written(slot_stats(records, spark, slots), "slot-stats")
    old = first_map(stats, shards)
    if maps is not None:
        # sub-slots that the map doesn't know yet are dealt in turn
        known = latest(maps)
        old = known.unionByName(old.drop("version").join(known, "virtual_slot", "left_anti").crossJoin(F.broadcast(known.agg(F.max("version").alias("version")))))
    versions = written(old.unionByName(rebalanced(old, stats, shards)), "slot-map")
    # one row a slot: bounded by the slot count
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = latest(versions).join(stats, "virtual_slot").select(
        "virtual_slot", F.col("version").alias("map_version"), "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(places), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"))
    )
