"""Shards over fixed virtual slots.

A record's id is hashed into one of ``SLOTS`` virtual slots, for good. Bytes are summed per slot,
and a map says which shard holds which slot. Slots, not records, are placed: the largest slot first,
each on the shard with the fewest bytes so far. The map is a table of ``SLOTS`` rows with a version;
rebalancing and changing the number of shards append a version in which only as many slots as needed
have moved, so that records follow their slot and most stay where they are. A slot is small (a few
thousandths of a shard), so shard sizes come out nearly equal.

The hash spreads any order of ids; records of one id share a slot. Only sizes per slot reach the
driver, ``SLOTS`` rows whatever the table's size; the map of ``SLOTS`` rows is broadcast.

Null or empty text has size 1 (its line end) and checksum 0; a NULL id hashes like a value of its
own; repeated rows each take a place; an empty table gives an empty result and still a map. Extra
columns are ignored whatever their names, and ``write_shards`` keeps them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rubrica.llm.common import read
from rubrica.session import fresh_path

SHARDS = 8
#: Virtual slots. Fixed for the life of a data set: records keep their slot.
SLOTS = 8192
#: A shard may hold this much more than its share before slots move.
TOLERANCE = 0.01
FIRST_VERSION = 1
MAP_SCHEMA = "version int, slot int, shard int, bytes bigint"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0"))), F.lit(slots)).cast("int")


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 and of the line end behind it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("bigint")


def slot_totals(docs: DataFrame, size: Column, key: str = "doc_id", slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot, added up before the shuffle; ``slots`` sums reach the driver."""
    sized = docs.select(slot_of(F.col(key), slots).alias("slot"), size.alias("size"))
    sums, rows = [0] * slots, [0] * slots
    for row in sized.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        sums[row["slot"]], rows[row["slot"]] = row["bytes"], row["n"]
    return sums, rows


def first_map(sums: Sequence[int], shards: int = SHARDS) -> list[int]:
    """Shard per slot: the largest slot first, each to the shard with the fewest bytes (then the
    fewest slots, then the lowest number)."""
    heap = [(0, 0, shard) for shard in range(shards)]
    placed = [0] * len(sums)
    for slot in sorted(range(len(sums)), key=lambda s: (-sums[s], s)):
        size, count, shard = heap[0]
        placed[slot] = shard
        heapq.heapreplace(heap, (size + sums[slot], count + 1, shard))
    return placed


def rebalanced(placed: Sequence[int], sums: Sequence[int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited for new slot sizes or another number of shards.

    Slots of shards that are gone move first; then, while a shard holds more than its share and the
    tolerance, its largest slot that still fits goes to the shard with the fewest bytes.
    """
    placed = list(placed)
    totals = [0] * shards
    for slot, shard in enumerate(placed):
        if shard < shards:
            totals[shard] += sums[slot]
    homeless = sorted((s for s, shard in enumerate(placed) if shard >= shards), key=lambda s: (-sums[s], s))
    for slot in homeless:
        to = min(range(shards), key=lambda s: (totals[s], s))
        placed[slot] = to
        totals[to] += sums[slot]
    share = sum(totals) / shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(range(len(placed)), key=lambda s: (sums[s], s)):
        own[placed[slot]].append(slot)
    for source in sorted(range(shards), key=lambda s: -totals[s]):
        kept = []
        while own[source] and totals[source] > share * (1 + tolerance):
            slot = own[source].pop()
            to = min(range(shards), key=lambda s: (totals[s], s))
            if sums[slot] and totals[to] + sums[slot] < totals[source]:
                placed[slot] = to
                totals[source] -= sums[slot]
                totals[to] += sums[slot]
            else:
                kept.append(slot)
        own[source] += kept
    return placed


def store_map(spark: SparkSession, placed: Sequence[int], sums: Sequence[int], folder: str, version: int) -> None:
    """Append a version of the map; earlier versions stay readable."""
    rows = [(version, slot, shard, int(size)) for slot, (shard, size) in enumerate(zip(placed, sums))]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[int], list[int]]:
    """Version, shard per slot and bytes per slot of a stored map, by default the latest."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(folder)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("slot").collect()
    return version, [r["shard"] for r in rows], [r["bytes"] for r in rows]


def rebalance(spark: SparkSession, docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> int:
    """Edit the stored map for the records as they are now and store it as the next version."""
    version, placed, _ = load_map(spark, folder)
    sums, _ = slot_totals(docs, size_of(F.col(text).cast("string")), key, len(placed))
    store_map(spark, rebalanced(placed, sums, shards), sums, folder, version + 1)
    return version + 1


def assign(docs: DataFrame, placed: Sequence[int], rows: Sequence[int], key: str = "doc_id", tie: str = "text") -> DataFrame:
    """Add to each row ``_slot`` (virtual slot), ``_shard`` and ``_place`` (its place in the shard,
    without gaps from 0): the rows of the shard's earlier slots, and the place within its slot.

    ``rows`` are the rows per slot; ``tie`` orders records of one id.
    """
    before, taken = [], {}
    for slot, (shard, count) in enumerate(zip(placed, rows)):
        before.append((slot, shard, taken.get(shard, 0)))
        taken[shard] = taken.get(shard, 0) + count
    table = docs.sparkSession.createDataFrame(before, "_at int, _shard int, _before bigint")
    df = docs.withColumn("_slot", slot_of(F.col(key), len(placed)))
    order = Window.partitionBy("_slot").orderBy(key, tie)
    df = df.withColumn("_rank", F.row_number().over(order).cast("bigint") - 1)
    df = df.join(F.broadcast(table), F.col("_slot") == F.col("_at"), "left")
    return df.withColumn("_place", F.col("_before") + F.col("_rank")).drop("_at", "_before", "_rank")


def write_shards(docs: DataFrame, placed: Sequence[int], folder: str, key: str = "doc_id") -> None:
    """Write the documents to one folder per shard, ``shard=N``, spread over tasks by slot."""
    taken = {f.lower() for f in docs.columns}
    name = next(n for n in ("shard", "_shard", "__shard") if n not in taken)
    table = docs.sparkSession.createDataFrame(list(enumerate(placed)), f"_at int, `{name}` int")
    rows = docs.withColumn("_slot", slot_of(F.col(key), len(placed)))
    rows = rows.join(F.broadcast(table), F.col("_slot") == F.col("_at")).repartition(name, F.pmod("_slot", F.lit(64)))
    rows.drop("_at", "_slot").write.partitionBy(name).parquet(folder)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sums, rows = slot_totals(docs, size_of(F.col("text")))
    folder = fresh_path(spark, "shard_map")
    store_map(spark, first_map(sums), sums, folder, FIRST_VERSION)
    version, placed, _ = load_map(spark, folder, FIRST_VERSION)
    # the text itself takes no part in the shuffle by slot
    slim = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(content).alias("text_crc32"))
    return assign(slim, placed, rows, "doc_id", "text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_slot").alias("virtual_slot"),
        F.lit(version).cast("int").alias("map_version"),
    )
