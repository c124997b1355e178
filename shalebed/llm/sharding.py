"""Sharding: fixed virtual slots and a versioned map from slots to shards.

Every record hashes into one of ``N_SLOTS`` virtual slots, for good. Spark adds up the bytes
of each slot; a map from slots to shards is packed from those sums, stored under a version,
and edited when shards are added or loads drift. Only slots that the edit names move.

Defined results: a null text counts as no bytes (size 16, CRC 0); rows without doc_id are
spread over the slots by where they lie, so that equal ones are no hot slot; repeated rows stay
together and are numbered in any order among themselves; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import stored

N_SLOTS = 8192
RECORD_BYTES = 16
MAP_SCHEMA = "virtual_slot int, shard int, bytes long, n_rows long"

Loads = dict[int, tuple[int, int]]


def slot_of(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record: its id and text decide, so that copies of a text spread."""
    return F.pmod(F.xxhash64(doc_id, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_slots)).cast("int")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(doc_id.isNull(), spread).otherwise(slot_of(doc_id, text, n_slots)).alias("virtual_slot"),
    )


def loads(records: DataFrame) -> Loads:
    """(bytes, rows) of each slot; at most one row a slot reaches the driver."""
    return {r[0]: (r[1], r[2]) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def pack(of: Loads, n_shards: int) -> dict[int, int]:
    """Largest slot first, each into the lightest shard: sizes end within a small slot of each other."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for slot, (size, _) in sorted(of.items(), key=lambda x: (-x[1][0], x[0])):
        light, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (light + size, shard))
    return out


def rebalance(old: dict[int, int], of: Loads, n_shards: int) -> dict[int, int]:
    """An edit of the map for new loads or more shards that moves few slots.

    Slots without a place go first; then the heaviest shard gives its best fitting slot to the
    lightest one for as long as that narrows the gap between the two.
    """
    out = {s: old[s] for s in of if old.get(s, n_shards) < n_shards}
    held: list[dict[int, int]] = [{} for _ in range(n_shards)]
    for s, shard in out.items():
        held[shard][s] = of[s][0]
    total = [sum(h.values()) for h in held]
    for s in sorted(of.keys() - out.keys(), key=lambda s: (-of[s][0], s)):
        shard = min(range(n_shards), key=lambda k: (total[k], k))
        held[shard][s] = of[s][0]
        total[shard] += of[s][0]
    for _ in range(4 * len(of)):
        high, low = (f(range(n_shards), key=lambda k: (total[k], k)) for f in (max, min))
        gap = total[high] - total[low]
        fit = [(abs(gap - 2 * size), s) for s, size in held[high].items() if 0 < size < gap]
        if not fit:
            break
        s = min(fit)[1]
        size = held[high].pop(s)
        held[low][s] = size
        total[high] -= size
        total[low] += size
    return {s: shard for shard, h in enumerate(held) for s in h}


def save_map(spark: SparkSession, path: str, version: int, shards: dict[int, int], of: Loads) -> None:
    """Stores one version of the map; a version that exists is never changed."""
    rows = [(s, shard, *of.get(s, (0, 0))) for s, shard in sorted(shards.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its number there, gapless from 0.

    The map has at most one row a virtual slot and is broadcast. A record's number is the
    count of rows in the shard's earlier slots, read off the map, plus its rank in its own
    slot, so that no task ever sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(offsets), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "virtual_slot",
    )


def shard(docs: DataFrame, n_shards: int, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Packs and stores version 1 of the map at ``path`` and places all records by it.

    The records (28 bytes each, no text) are stored, so that their slots are decided once.
    """
    records = stored(sized(docs, n_slots), "records")
    of = loads(records)
    save_map(docs.sparkSession, path, 1, pack(of, n_shards), of)
    return place(records, load_map(docs.sparkSession, path, 1))


def grow(docs: DataFrame, n_shards: int, more: int, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, virtual_slot, before, after): shards by version 1 of the map, and by its edit for more shards, version 2."""
    records, spark = stored(sized(docs, n_slots), "records"), docs.sparkSession
    of = loads(records)
    first = pack(of, n_shards)
    save_map(spark, path, 1, first, of)
    save_map(spark, path, 2, rebalance(first, of, n_shards + more), of)
    old, new = (load_map(spark, path, v).select("virtual_slot", F.col("shard").alias(name)) for v, name in ((1, "before"), (2, "after")))
    return records.join(F.broadcast(old), "virtual_slot").join(F.broadcast(new), "virtual_slot").select("doc_id", "size", "virtual_slot", "before", "after")
