"""Sharding by fixed virtual slots.

A record is hashed into one of a fixed number of slots, and only slots are dealt to
shards: a map of some thousand rows, kept in versions that are never overwritten.
Rebalancing edits the map: every shard keeps its largest slots up to an equal share of
the bytes and gives up the rest, which go, largest first, to the shard that has least.
A shard more takes slots from the others and moves nothing between them.

Everything is SQL expressions.  What is gathered in one place is the slots, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.scratch import materialise, new_path

SLOTS = 4096
SHARDS = 8


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` per row; size is the text's UTF-8 bytes (null: none) and 1.

    The hash takes the id and the text's checksum and size, so rows without an id, or of one id, spread by their
    texts.  Rows equal in all of them share a slot.  Other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    return base.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(virtual_slot, n_rows, n_bytes)`` of every slot, empty ones included."""
    found = rows.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["n_rows", "n_bytes"])


def initial_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """``(virtual_slot, shard)`` with equally many slots a shard, at most one apart."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def _kept(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map with ``n_bytes`` and ``kept``: whether the slot is among the largest of its shard that an equal share holds."""
    total = loads.agg((F.sum("n_bytes") / shards).alias("__share"))
    full = W.partitionBy("shard").orderBy(F.desc("n_bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    met = slot_map.select("virtual_slot", "shard").join(loads.select("virtual_slot", "n_bytes"), "virtual_slot").join(F.broadcast(total))
    return met.withColumn("kept", F.sum("n_bytes").over(full) <= F.col("__share")).drop("__share")


def _dealt(released: Column, loads: Column) -> Column:
    """Array of (virtual_slot, shard): each released (n_bytes, virtual_slot), in order, to the shard with least so far."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"))

    def place(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        grown = F.transform(state["loads"], lambda x, i: x + F.when(i == shard, slot["n_bytes"]).otherwise(F.lit(0)))
        put = F.struct(slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))
        return F.struct(grown.alias("loads"), F.concat(state["placed"], F.array(put)).alias("placed"))

    return F.aggregate(released, start, place)["placed"]


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited so that shards hold nearly equal bytes; slots that fit where they are stay there.

    A shard exceeds an equal share by at most one released slot, unless one slot alone exceeds it.
    Without rows, or with equal loads already, the map stays as it is.
    """
    spark = slot_map.sparkSession
    marked = _kept(slot_map, loads, shards)
    held = marked.where("kept").groupBy("shard").agg(F.sum("n_bytes").alias("held"))
    held = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left").na.fill(0, ["held"])
    held = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "held"))), lambda s: s["held"]).alias("loads"))
    gone = marked.where("not kept").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("rank"), "virtual_slot", "n_bytes"))).alias("gone"))
    placed = held.join(F.broadcast(gone)).select(F.explode(_dealt(F.col("gone"), F.col("loads"))).alias("p")).select("p.*")
    return marked.where("kept").select("virtual_slot", "shard").unionByName(placed)


def grow(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map with one shard more, number ``shards``: it takes what the others hold beyond their new share, and nothing else moves."""
    marked = _kept(slot_map, loads, shards + 1)
    return marked.select("virtual_slot", F.when(F.col("kept"), F.col("shard")).otherwise(F.lit(shards)).alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of the map; a version that exists is an error and stays as it is."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(virtual_slot, shard, version)`` of a version, by default the last."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    last = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == F.lit(last))


def assign(rows: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with ``shard`` and ``slot``, their place in the shard from 0 without gaps.

    A row is numbered inside its virtual slot (by id, checksum and size; equal rows among
    themselves at will) after all rows of the shard's slots before, so no shard is sorted whole.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard").join(loads, "virtual_slot").withColumn("__start", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("__in", F.row_number().over(inside)).join(F.broadcast(starts.select("virtual_slot", "shard", "__start")), "virtual_slot")
    return placed.withColumn("slot", (F.col("__start") + F.col("__in") - 1).cast("bigint")).drop("__start", "__in")


def sharded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot, shard, slot)`` per row of ``docs``; the map's versions 1 (as dealt) and 2 (rebalanced) go to ``path``.

    Nulls count as empty texts and ids may be null or repeat; an empty table gives no rows and an equal deal of slots.
    """
    spark = docs.sparkSession
    rows = materialise(measured(docs, doc_id, text, slots), "measured")
    loads = materialise(slot_loads(rows, slots).coalesce(1), "slot_loads")
    save_map(initial_map(spark, slots, shards), path, 1)
    save_map(rebalance(load_map(spark, path, 1), loads, shards), path, 2)
    return assign(rows, loads, load_map(spark, path, 2))


def op11_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of nearly equal bytes (law ``bytes``), by a map of 4,096 slots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sharded(docs, new_path(spark, "slot_map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
