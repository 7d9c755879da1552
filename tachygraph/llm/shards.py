"""Minimax contiguous partition: shards of ordered atomic groups whose largest shard is as small as can be.

A group is all rows of one text; it is never cut. Groups stand in the order of their text's hash. The smallest feasible
capacity is found by binary search; a capacity is feasible if greedy filling (each shard takes groups until the next one
would not fit) needs no more than the wanted shards. Then the cuts are made there. Law: ``bytes``.

The walk needs only prefix sums. They are kept in two levels: blocks of at most BLOCK groups, of which the driver holds the
sums, and the groups of the few blocks in which cuts fall, which it fetches one block at a time. So its memory is bounded
by the number of blocks and BLOCK, and one pass over the data serves all steps of the search.

Slots number the rows of a shard from 0 without gaps, in the order of (hash, doc_id): the rows are range-partitioned on
both, so that the copies of one text spread over many tasks, and a task's first slot follows from the row counts of those before.

Nulls: a null text has size 1 and crc32 0; all null texts are one group, apart from the empty text's. A null doc_id sorts
first. Repeated rows get a slot each. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm.scratch import table

SHARDS = 16
BLOCK = 100_000


def fill(total: int, capacity: int, locate: Callable[[int], tuple[int, int]]) -> list[int]:
    """Greedy cuts: for each shard but the first, the index of its first group. ``locate(limit)`` gives the index of the first
    group whose end lies beyond ``limit``, and the sum of all groups before it. Stops once everything is placed."""
    cuts, placed = [], 0
    while True:
        index, placed_next = locate(placed + capacity)
        if placed_next >= total:
            return cuts
        if placed_next == placed:
            raise ValueError("a group is larger than the capacity")
        cuts.append(index)
        placed = placed_next


def smallest_capacity(total: int, largest: int, shards: int, locate: Callable[[int], tuple[int, int]]) -> int:
    """The least capacity at which greedy filling needs at most ``shards``."""
    low = max(largest, -(-total // shards))
    high = low + largest  # greedy filling wastes less than one group in a shard
    while low < high:
        middle = (low + high) // 2
        if len(fill(total, middle, locate)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


class Prefix:
    """Prefix sums of ordered groups in two levels; a block's groups are fetched when a cut falls into it."""

    def __init__(self, blocks: list[tuple[int, int, int]], fetch: Callable[[int], list[int]]):
        """blocks: (name, groups, sum) in order; fetch: the sizes of a block's groups, in order."""
        self.names, self.firsts, self.sums, groups, total = [], [], [], 0, 0
        for name, n, size in blocks:
            self.names.append(name)
            self.firsts.append(groups)
            self.sums.append(total)
            groups, total = groups + n, total + size
        self.groups, self.total = groups, total
        self._ends = lru_cache(maxsize=64)(lambda at: self._prefix(fetch(self.names[at]), self.sums[at]))

    @staticmethod
    def _prefix(sizes: list[int], start: int) -> list[int]:
        out = []
        for x in sizes:
            start += x
            out.append(start)
        return out

    def locate(self, limit: int) -> tuple[int, int]:
        if limit >= self.total:
            return self.groups, self.total
        at = bisect_right(self.sums, limit) - 1
        ends = self._ends(at)
        k = bisect_right(ends, limit)
        return self.firsts[at] + k, ends[k - 1] if k else self.sums[at]


def _thin(docs: DataFrame) -> DataFrame:
    text: Column = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("hash"), size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )


def minimax_shards(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = table(_thin(docs), "thin")
    groups = rows.groupBy("hash").agg(F.sum("size").alias("size"))
    ranged = groups.repartitionByRange(parts, "hash").sortWithinPartitions("hash").select("*", F.monotonically_increasing_id().alias("at"))
    #: Task numbers are in the upper bits of ``at``; each task's groups fall into blocks of at most ``block``.
    row = F.col("at").bitwiseAND((1 << 33) - 1)
    ranged = table(ranged.withColumn("block", F.col("at") - row + F.floor(row / block)), "groups")
    sums = sorted(tuple(r) for r in ranged.groupBy("block").agg(F.count("*"), F.sum("size"), F.max("size"), F.min("hash")).collect())
    if not sums:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    fetch = lambda b: [r[0] for r in ranged.filter(F.col("block") == b).orderBy("at").select("size").collect()]
    prefix = Prefix([(b, n, s) for b, n, s, _, _ in sums], fetch)
    capacity = smallest_capacity(prefix.total, max(x[3] for x in sums), shards, prefix.locate)
    cuts = fill(prefix.total, capacity, prefix.locate)
    starts = []
    for cut in cuts:
        at = bisect_right(prefix.firsts, cut) - 1
        starts.append(ranged.filter(F.col("block") == prefix.names[at]).orderBy("at").offset(cut - prefix.firsts[at]).select("hash").first()[0])
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("hash") >= start).cast("int")
    placed = rows.withColumn("shard", shard).repartitionByRange(parts, "hash", "doc_id").sortWithinPartitions("hash", "doc_id").select("*", F.monotonically_increasing_id().alias("at"))
    task = F.shiftright("at", 33)
    placed = table(placed.withColumn("task", task), "placed")
    firsts = placed.groupBy("task", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    #: One row for each task and shard: as many as tasks, and a few for the cuts.
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.select("task", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    got = placed.join(F.broadcast(offsets), ["task", "shard"])
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
