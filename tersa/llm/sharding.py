"""Sharding by fixed virtual slots: thousands of slots by hash, bytes summed a slot, and a
versioned slot-to-shard map that is edited, not recomputed, when shards are added.

Only DataFrame functions touch rows. The driver sees one row a slot, a number that
does not depend on the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersa.llm.common import new_path, pick, written

SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, rows long, bytes long, row_base long"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row.

    ``size`` is the UTF-8 length plus 8; a null text counts as empty; a null id has a
    slot like any other value. The slot depends on the id and the text, so rows that
    share an id but not their text spread. Rows repeated whole share a slot.
    """
    docs = pick(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each slot that has any: at most ``slots`` rows reach the driver."""
    sums = rows.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return {r["vslot"]: (r["rows"], r["bytes"]) for r in sums.collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Each slot to a shard: heaviest slot first, always to the lightest shard so far."""
    load = [(0, s) for s in range(shards)]
    heapq.heapify(load)
    out = {}
    for slot in sorted(range(slots), key=lambda v: (-sizes.get(v, (0, 0))[1], v)):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + sizes.get(slot, (0, 0))[1], shard))
    return out


def grown_map(slot_map: dict[int, int], sizes: dict[int, tuple[int, int]]) -> dict[int, int]:
    """The map edited for one more shard: slots move only into the new one.

    From the heaviest shard, the largest slot that keeps the new shard at or under the
    new mean moves, until nothing fits.
    """
    shards = max(slot_map.values(), default=-1) + 1
    weight = lambda v: sizes.get(v, (0, 0))[1]
    goal = sum(map(weight, slot_map)) / (shards + 1)
    owned: dict[int, list[int]] = {}
    for slot in sorted(slot_map, key=lambda v: (weight(v), v)):
        owned.setdefault(slot_map[slot], []).append(slot)
    load = {s: sum(map(weight, own)) for s, own in owned.items()}
    out, filled = dict(slot_map), 0
    while load:
        shard = max(load, key=lambda s: (load[s], -s))
        fits = next((v for v in reversed(owned[shard]) if weight(v) and filled + weight(v) <= goal), None)
        if fits is None or load[shard] - weight(fits) < goal - weight(fits):
            load.pop(shard)
            continue
        owned[shard].remove(fits)
        load[shard] -= weight(fits)
        filled += weight(fits)
        out[fits] = shards
    return out


def map_rows(slot_map: dict[int, int], sizes: dict[int, tuple[int, int]], version: int) -> list[tuple]:
    """MAP_SCHEMA rows; ``row_base`` is the number of rows in earlier slots of the same shard."""
    base: dict[int, int] = {}
    out = []
    for slot in sorted(slot_map):
        shard, (rows, size) = slot_map[slot], sizes.get(slot, (0, 0))
        out.append((version, slot, shard, rows, size, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + rows
    return out


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Adds a version to the map table; earlier versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def newest_map(spark: SparkSession, path: str) -> list[tuple]:
    """The MAP_SCHEMA rows of the last version at ``path``, by slot; none where there is no map."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    version = spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]
    return sorted(tuple(r) for r in read_map(spark, path, version).collect()) if version else []


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every row with its shard and its place there, gapless from 0.

    The map has one row a slot, 4,096 by default, so it is broadcast. Places come from the
    map's row bases and a row number within a slot: no shard is ever sorted as a whole.
    """
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    held = F.broadcast(slot_map.select("vslot", "shard", "row_base"))
    return (
        rows.withColumn("_n", F.row_number().over(within) - 1)
        .join(held, "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("row_base") + F.col("_n")).alias("slot"), "vslot")
    )


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, vslot for every row of ``docs`` (doc_id, text).

    Shards have near-equal bytes. The slot map is stored as version 1 at ``map_path`` (by
    default in the shared folder). Where that holds a map, its last version is read and edited for as many more
    shards as are asked for; what differs from it, in shards or in the rows of slots, is published as the next version. An empty table gives no rows; repeated rows keep their
    number and get places of their own; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, slots), "slotted")
    sizes = slot_sizes(rows)
    path = map_path or new_path(spark, "slot-map")
    held = newest_map(spark, path)
    version, slot_map = 1, None
    if held:
        version, slot_map = held[0][0], {r[1]: r[2] for r in held}
        have = max(slot_map.values()) + 1
        if len(slot_map) != slots or have > shards:
            raise ValueError(f"the map at {path} has {len(slot_map)} slots and {have} shards")
        for _ in range(shards - have):
            slot_map = grown_map(slot_map, sizes)
    made = map_rows(slot_map or first_map(sizes, shards, slots), sizes, version)
    if made != held:
        version += bool(held)
        save_map(spark, [(version, *r[1:]) for r in made], path)
    return placed(rows, read_map(spark, path, version))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """The documents themselves, one folder a shard, under a slot map."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(
        "_vslot", F.pmod(F.xxhash64("doc_id", F.crc32(text.cast("binary"))), F.lit(slots)).cast("int")
    )
    held = F.broadcast(slot_map.select(F.col("vslot").alias("_vslot"), F.col("shard").alias("_shard")))
    keyed.join(held, "_vslot").drop("_vslot").write.partitionBy("_shard").parquet(path)
