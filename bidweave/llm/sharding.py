"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, text and copy number, and never changes. A versioned map
sends slots to shards; rebalancing sums bytes by slot and edits as few entries
as it can. Only the map and the slot sums (both of a fixed size) reach the driver.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def initial(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt round."""
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def moved(self, other: SlotMap) -> int:
        """Slots whose shard differs."""
        return sum(a != b for a, b in zip(self.shard_of, other.shard_of, strict=True))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None, tolerance: float = 1e-4) -> SlotMap:
        """The next version: single slots, then swaps, go from the heaviest shard to the lightest.

        Ends when the spread is within ``tolerance`` of the mean, or when no move narrows it. With more
        shards than before the new ones start empty; with fewer, the slots of those that go are dealt out first.
        """
        shards = shards or self.shards
        place = list(self.shard_of)
        load = [0] * shards
        own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(place):
            size = slot_bytes.get(slot, 0)
            if shard < shards:
                load[shard] += size
                own[shard].append((size, slot))
            else:
                homeless.append((size, slot))
        for size, slot in sorted(homeless, reverse=True):
            to = load.index(min(load))
            place[slot] = to
            load[to] += size
            own[to].append((size, slot))
        for x in own:
            x.sort()
        goal = tolerance * sum(load) / shards

        def shift(size: int, slot: int, a: int, b: int) -> None:
            own[a].remove((size, slot))
            bisect.insort(own[b], (size, slot))
            place[slot] = b
            load[a] -= size
            load[b] += size

        for _ in range(4 * len(place)):
            high, low = load.index(max(load)), load.index(min(load))
            gap = load[high] - load[low]
            if gap <= goal:
                break
            best, move = gap, None
            at = bisect.bisect_left(own[high], (gap / 2, -1))
            for i in (at - 1, at):
                if 0 <= i < len(own[high]) and abs(gap - 2 * own[high][i][0]) < best:
                    best, move = abs(gap - 2 * own[high][i][0]), (own[high][i], None)
            if best > goal:
                for x in own[high]:
                    i = bisect.bisect_left(own[low], (x[0] - gap / 2, -1))
                    for j in (i - 1, i):
                        if 0 <= j < len(own[low]) and abs(gap - 2 * (x[0] - own[low][j][0])) < best:
                            best, move = abs(gap - 2 * (x[0] - own[low][j][0])), (x, own[low][j])
            if move is None:
                break
            shift(*move[0], high, low)
            if move[1]:
                shift(*move[1], low, high)
        return SlotMap(self.version + 1, shards, tuple(place))

    def save(self, spark: SparkSession, root: str) -> str:
        """Write this version as a table of its own; earlier versions stay."""
        path = f"{root}/v={self.version}"
        row = (self.version, self.shards, list(self.shard_of))
        spark.createDataFrame([row], "version int, shards int, shard_of array<int>").coalesce(1).write.parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, root: str, version: int) -> SlotMap:
        row = spark.read.parquet(f"{root}/v={version}").first()
        return SlotMap(row["version"], row["shards"], tuple(row["shard_of"]))


#: Copies of one record that share a slot: copy number n is hashed with n // SPREAD.
SPREAD = 16


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and how many equal rows lie there; the text goes no further.

    A slot is a hash of id, text and ``copy number // SPREAD``. Equal rows are counted, before the shuffle too, and as
    they can't be told apart, their copy numbers are 0, 1, 2 and so on: the slots of a table don't depend on how it is
    partitioned, and no record moves when another copy arrives. A record of any number of copies is one row here for each
    ``SPREAD`` of them, in as many slots as there are.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("_hash"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32", "_hash").agg(F.count("*").alias("_n"))
    part = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SPREAD).cast("long"))))
    slot = F.when(F.col("_part") == 0, F.pmod("_hash", F.lit(slots))).otherwise(F.pmod(F.xxhash64("_hash", "_part"), F.lit(slots)))
    copies = F.least(F.lit(SPREAD).cast("long"), F.col("_n") - F.col("_part") * SPREAD)
    return part.select("doc_id", "size", "text_crc32", slot.cast("int").alias("virtual_slot"), copies.alias("copies"))


def slot_sums(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes by slot: at most one row a slot, summed before the shuffle."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("b")).collect()
    return {r["virtual_slot"]: (r["n"], r["b"]) for r in rows}


def shard_documents(slotted: DataFrame, slot_map: SlotMap, sums: dict[int, tuple[int, int]]) -> DataFrame:
    """Each row's shard by the map, and its place there; ``slotted`` is a written table of ``with_slots``.

    Places are gapless: a slot's first place is the number of rows in the shard's slots before it, and rows
    are numbered within their slot only, so no task sees more than a slot. Rows of one slot stand in the order of
    doc_id (null last), text_crc32 and size; the order of equal rows does not matter, and they come out as often as they went in. Null ids and texts count as any
    other (a null text has no bytes), texts of any length are only hashed, other columns are not read, and an empty
    table gives no rows.
    """
    taken = [0] * slot_map.shards
    first = []
    for slot, shard in enumerate(slot_map.shard_of):
        first.append(taken[shard])
        taken[shard] += sums.get(slot, (0, 0))[0]
    spark = slotted.sparkSession
    rows = list(zip(range(len(first)), slot_map.shard_of, first, strict=True))
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, first long")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slotted.withColumn("_before", F.coalesce(F.sum("copies").over(order), F.lit(0)))
        .join(F.broadcast(places), "virtual_slot")
        .withColumn("_n", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("copies") - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("_n")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(slot_map.version).alias("map_version"),
        )
    )
