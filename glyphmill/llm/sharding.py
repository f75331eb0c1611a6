"""Sharding over fixed virtual slots: records are hashed into thousands of slots, bytes are summed per slot, and a small
versioned map says which shard each slot is on. Rebalancing edits the map and moves whole slots."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import new_path, written

SLOTS = 4096
#: Bytes that each record takes besides its text.
OVERHEAD = 8


@dataclass
class SlotMap:
    """shard_of[s]: the shard of slot s. Each edit makes a new version; moved lists what it moved."""

    shard_of: list[int]
    n_shards: int
    version: int = 0
    moved: list[int] = field(default_factory=list)

    @staticmethod
    def initial(n_slots: int, n_shards: int) -> SlotMap:
        return SlotMap([s % n_shards for s in range(n_slots)], n_shards)

    def rebalanced(self, bytes_of: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version, for as many or more shards: slots leave shards that are over the mean, largest first, for
        the shard with least; then single slots move from the fullest to the emptiest shard while that brings them closer."""
        n = n_shards or self.n_shards
        shard_of, loads = [s % n for s in self.shard_of] if n < self.n_shards else [*self.shard_of], [0] * n
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for s, shard in enumerate(shard_of):
            loads[shard] += bytes_of.get(s, 0)
            held[shard].append((bytes_of.get(s, 0), s))
        mean, pool = sum(loads) / n, []
        for shard in range(n):
            for size, s in sorted(held[shard], reverse=True):
                if size and loads[shard] - size >= mean or size and loads[shard] > mean and loads[shard] - mean > size / 2:
                    loads[shard] -= size
                    pool.append((size, s))
        queue = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(queue)
        for size, s in sorted(pool, key=lambda x: (-x[0], x[1])):
            load, shard = heapq.heappop(queue)
            shard_of[s] = shard
            heapq.heappush(queue, (load + size, shard))
        loads = [0] * n
        held = [[] for _ in range(n)]
        for s, shard in enumerate(shard_of):
            loads[shard] += bytes_of.get(s, 0)
            held[shard].append((bytes_of.get(s, 0), s))
        for _ in range(4 * len(shard_of)):
            high, low = max(range(n), key=loads.__getitem__), min(range(n), key=loads.__getitem__)
            gap = loads[high] - loads[low]
            best = min(((abs(gap - 2 * size), s, size) for size, s in held[high] if 0 < size < gap), default=None)
            if best is None:
                break
            _, s, size = best
            held[high].remove((size, s))
            held[low].append((size, s))
            loads[high], loads[low], shard_of[s] = loads[high] - size, loads[low] + size, low
        return SlotMap(shard_of, n, self.version + 1, [s for s, (a, b) in enumerate(zip(self.shard_of, shard_of, strict=True)) if a != b])

    def save(self, spark: SparkSession, path: str) -> None:
        """Versions lie beside each other; none is overwritten, and to save one again is an error."""
        row = [(json.dumps({"shard_of": self.shard_of, "n_shards": self.n_shards, "moved": self.moved}),)]
        spark.createDataFrame(row, "map string").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version, by default the last; None where nothing has been saved."""
        try:
            rows = spark.read.schema("map string, version int").parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        chosen = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))
        row = chosen.first()
        return row and SlotMap(version=row["version"], **json.loads(row["map"]))


#: Rows of a slot that one task numbers.
NUMBERED_ROWS = 250_000


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, map_path: str | None = None) -> DataFrame:
    """For each row: doc_id, size, text_crc32, law `bytes`, shard 0..n_shards-1, slot (the row's place in its shard, from 0 without
    gaps), grown_shard (null under this law) and virtual_slot.

    Rows with equal texts share a virtual slot, and so a shard. Only a group that alone exceeds a shard's even share of the bytes, of which
    there are fewer than n_shards, is dealt over more slots, row by row. The last version of the map at map_path (by default a new folder in
    the shared one) is rebalanced by the bytes of each slot and saved as the next; where there is none, version 0 deals slots in turn.
    A null text has no bytes and the crc32 of an empty one; very long texts are rows like others, and where one text is larger than an even share its
    shard is too. Null ids and repeated rows are rows of their own. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row"),
    )
    sized = written(sized, "shard-sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // n_shards)
    groups = sized.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = groups.where((F.col("bytes") > share) & (F.col("n") > 1)).select("group", F.ceil(F.col("bytes") * SLOTS / total).alias("parts"))
    slot = F.pmod(F.xxhash64("group", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))), F.lit(SLOTS)).cast("int")
    placed = written(sized.join(F.broadcast(large), "group", "left").withColumn("virtual_slot", slot).drop("parts", "group"), "shard-slots")

    per_slot = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # SLOTS rows at most
    path = map_path or new_path(spark, "slot-map")
    before = SlotMap.load(spark, path)
    if before is None:
        before = SlotMap.initial(SLOTS, n_shards)
        before.save(spark, path)
    current = before.rebalanced({r["virtual_slot"]: r["bytes"] for r in per_slot}, n_shards)
    current.save(spark, path)

    rows = {r["virtual_slot"]: r["n"] for r in per_slot}
    starts, at = [], [0] * n_shards
    for s in range(SLOTS):
        shard_of = current.shard_of[s]
        starts.append((s, shard_of, at[shard_of], -(-rows.get(s, 0) // NUMBERED_ROWS)))
        at[shard_of] += rows.get(s, 0)
    where = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, shard int, start long, parts int"))
    # a slot with very many rows is numbered in parts, of which there are a few for each slot
    own = placed.join(where, "virtual_slot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    parts = own.where("parts > 1").groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    begins = parts.select("virtual_slot", "part", (F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "row"))
    numbered = own.join(begins, ["virtual_slot", "part"], "left").withColumn("slot", F.col("start") + F.coalesce("before", F.lit(0)) + nth - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
