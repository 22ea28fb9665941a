"""Sharding over fixed virtual slots, in DataFrame functions only.

A record's hash puts it into one of some thousands of slots for good.  Bytes are
added up per slot, and a slot-to-shard map, a small versioned table, deals slots
out: the largest first, each to the shard that has the fewest bytes.  Rebalancing
edits the map under a new version and moves as few slots as it needs; records
never change their slot.

Defined results: null text has size 1 and the crc32 of the empty text; rows that
repeat a doc_id and text share a slot; equal texts under different ids may lie in
different shards, as a group of copies can outgrow any one of them; null doc_ids are hashed by their text; an
empty table gives an empty result; further columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SLOTS = 4096

# Slots (largest first) go to the shard that has the fewest bytes so far.
_DEAL = """
aggregate(slots, named_struct('loads', loads, 'to', cast(array() as array<int>)), (a, x) ->
  named_struct(
    'loads', transform(a.loads, (v, i) -> IF(i = cast(array_position(a.loads, array_min(a.loads)) as int) - 1, v + x.bytes, v)),
    'to', concat(a.to, array(cast(array_position(a.loads, array_min(a.loads)) as int) - 1))))
"""


def place_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) for docs(doc_id, text)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    crc = F.crc32(text)
    slot = F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), crc.alias("text_crc32"), slot.alias("virtual_slot"))


def slot_sizes(placed: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n): at most as many rows as there are slots."""
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def _dealt(sizes: DataFrame, loads, first: int) -> DataFrame:
    """(virtual_slot, shard) from one row of at most `slots` array elements; shards count from `first`."""
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("slots")).withColumn("loads", loads)
    dealt = listed.select("slots", F.expr(_DEAL).alias("a"))
    return dealt.select(F.explode(F.arrays_zip(F.col("slots"), F.col("a.to").alias("to"))).alias("x")).select("x.slots.virtual_slot", (F.col("x.to") + first).cast("int").alias("shard"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard)."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return _dealt(sizes, loads, 0).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def grow_map(current: DataFrame, sizes: DataFrame, shards: int, added: int = 1) -> DataFrame:
    """The next version of a map, edited for `added` more shards: each old shard gives up slots beyond the new
    mean, and only these move, all into new shards."""
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards + added)
    order = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    held = current.join(sizes, "virtual_slot").withColumn("leaves", F.sum("bytes").over(order) > mean)
    moved = _dealt(held.where("leaves").select("virtual_slot", "bytes"), F.array_repeat(F.lit(0).cast("long"), added), shards)
    version = current.agg(F.max("version")).first()[0] + 1
    stay = held.where("not leaves").select("virtual_slot", "shard")
    return stay.unionByName(moved).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append one version of a map to the table of all versions."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, by default the newest."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return table.where(F.col("version") == F.lit(version)).select("version", "virtual_slot", "shard")


def shard_records(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version.

    slot is the row's place in its shard, gapless from 0: rows are numbered inside
    each virtual slot, behind the rows of the shard's earlier slots.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    placed = scratch.save(place_records(docs, slots), "placed")
    sizes = scratch.save(slot_sizes(placed), "sizes")
    save_map(first_map(sizes, shards), scratch.path("map"))
    slot_map = load_map(docs.sparkSession, scratch.path("map"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = slot_map.join(sizes, "virtual_slot").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The map has at most `slots` rows, so it may go to every task.
    rows = placed.join(F.broadcast(table.select("virtual_slot", "shard", "first", "version")), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + place - 1).alias("slot"), F.col("version").alias("map_version"))
