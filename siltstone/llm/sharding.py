"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; bytes are added up per slot; a versioned map sends slots
to shards.  Rebalancing and growing edit the map: records never change their slot.  Everything here is DataFrame
code; the driver holds only the map (``n_slots`` numbers, whatever the size of the table).

Records hash by id, text and copy number, so rows that repeat, or share a null id, spread over the slots like any others;
which of several equal rows gets which place is all the same.

Defined results: a null text counts as empty (size 1, crc32 0); a null id is one value; repeated rows get places of their own;
equal sizes are ordered by id and text; a very long text weighs what it weighs and is never cut; an empty table gives an
empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.textops import numbered, prepared, scratch, stored

N_SLOTS = 4096
SUBSLOTS = 16


@dataclass(frozen=True)
class SlotMap:
    """Slot -> shard, with a version that each edit raises."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def balanced(cls, weights: list[int], n_shards: int) -> SlotMap:
        """Largest slot first, each to the lightest shard."""
        load = [(0, 0, s) for s in range(n_shards)]
        to = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            total, held, shard = heapq.heappop(load)
            to[slot] = shard
            heapq.heappush(load, (total + weights[slot], held + 1, shard))
        return cls(1, n_shards, tuple(to))

    def _loads(self, weights: list[int], n: int) -> list[int]:
        load = [0] * n
        for slot, shard in enumerate(self.shards):
            load[shard] += weights[slot]
        return load

    def rebalanced(self, weights: list[int], tolerance: float = 0.01) -> SlotMap:
        """Moves slots from the heaviest to the lightest shard while that narrows a spread above ``tolerance`` of the mean."""
        to, load = list(self.shards), self._loads(weights, self.n_shards)
        mean = sum(load) / max(1, len(load))
        own = [sorted((weights[i], i) for i in range(len(to)) if to[i] == s) for s in range(self.n_shards)]
        while max(load) - min(load) > tolerance * mean:
            high, low = load.index(max(load)), load.index(min(load))
            gap = load[high] - load[low]
            fit = [x for x in own[high] if 0 < x[0] < gap]
            if not fit:
                break
            weight, slot = min(fit, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
            own[high].remove((weight, slot))
            own[low].append((weight, slot))
            to[slot], load[high], load[low] = low, load[high] - weight, load[low] + weight
        return SlotMap(self.version + 1, self.n_shards, tuple(to))

    def grown(self, weights: list[int]) -> SlotMap:
        """One more shard: slots move into the new shard only, from the heaviest ones, until it holds its share."""
        to, load, new = list(self.shards), self._loads(weights, self.n_shards + 1), self.n_shards
        share = sum(load) / (self.n_shards + 1)
        for slot in sorted(range(len(to)), key=lambda i: (-weights[i], i)):
            if load[new] + weights[slot] <= share and load[to[slot]] - weights[slot] >= load[new]:
                load[to[slot]] -= weights[slot]
                load[new] += weights[slot]
                to[slot] = new
        return SlotMap(self.version + 1, self.n_shards + 1, tuple(to))

    def shard_of(self, slot):
        """Column: the shard of a slot column; the list is one folded literal."""
        return F.element_at(F.split(F.lit(",".join(map(str, self.shards))), ","), slot + 1).cast("int")

    def frame(self, spark: SparkSession) -> DataFrame:
        slot = F.col("id").cast("int")
        return spark.range(len(self.shards)).select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), slot.alias("virtual_slot"), self.shard_of(slot).alias("shard"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version beside the others at ``path``; a second try replaces the first."""
        self.frame(spark).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
        if not rows or [r["virtual_slot"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"no whole map of version {version} at {path}")
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy_ (number among equal rows), virtual_slot and a finer subslot of every record; stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = numbered(own, F.xxhash64("doc_id", "text_crc32"), "sizes").withColumn("h", F.xxhash64("doc_id", "text_crc32", "copy_"))
    slot, sub = F.pmod("h", F.lit(n_slots)).cast("int"), F.pmod(F.shiftrightunsigned("h", 32), F.lit(SUBSLOTS)).cast("int")
    return stored(own.select("doc_id", "size", "text_crc32", "copy_", slot.alias("virtual_slot"), sub.alias("subslot")), "slots")


def slot_bytes(slots: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per slot of what ``slotted`` gave: n_slots numbers."""
    out = [0] * n_slots
    for r in slots.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect():
        out[r["virtual_slot"]] = r["size"]
    return out


def mapped(spark: SparkSession, weights: list[int], n_shards: int, path: str, tolerance: float = 0.01) -> SlotMap:
    """The map stored at ``path``: a first version where there is none; else the last one, edited and stored anew if the shards drifted apart."""
    jvm, where = spark._jvm, f"{path}/version=1"
    folder = jvm.org.apache.hadoop.fs.Path(where)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        SlotMap.balanced(weights, n_shards).save(spark, path)
        return SlotMap.load(spark, path)
    last = SlotMap.load(spark, path)
    edited = last.rebalanced(weights, tolerance)
    while edited.n_shards < n_shards:
        edited = edited.grown(weights)
    if edited.shards != last.shards or edited.n_shards != last.n_shards:
        edited = SlotMap(last.version + 1, edited.n_shards, edited.shards)
        edited.save(spark, path)
        return SlotMap.load(spark, path)
    return last


def sharded(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, map_version, shard, and slot: the record's place in its shard, gapless from 0.

    The versioned map lives at ``map_path`` (by default in the shared folder).  Places are counted within small (slot, subslot)
    groups and shifted by the groups before, so no task sees a shard whole.
    """
    spark = docs.sparkSession
    rows = slotted(docs, n_slots)
    slot_map = mapped(spark, slot_bytes(rows, n_slots), n_shards, map_path or scratch(spark, "slot-map"))
    rows = rows.withColumn("shard", slot_map.shard_of(F.col("virtual_slot")))
    groups = rows.groupBy("shard", "virtual_slot", "subslot").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "subslot").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.select("virtual_slot", "subslot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("virtual_slot", "subslot").orderBy("doc_id", "text_crc32", "copy_")) - 1
    ranked = rows.withColumn("place", place)
    # The table of starts has at most n_slots * SUBSLOTS rows, whatever the input.
    return ranked.join(F.broadcast(starts), ["virtual_slot", "subslot"]).select("doc_id", "size", "text_crc32", "virtual_slot", F.lit(slot_map.version).alias("map_version"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: the map balances what the slots weigh."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
