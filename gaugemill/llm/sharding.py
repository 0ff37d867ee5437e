"""Shards of nearly equal bytes by a minimax contiguous partition of ordered atomic groups.

Rows of equal texts form a group that no shard divides. Groups are ordered by 64-bit hash of the text; its leading 16 bits make at
most 65,536 ordered atomic units (several groups may share one, equal texts always do), so that the driver holds at most that
many sizes for any input. It searches for the smallest capacity with which a greedy walk needs no more than the wanted
shards, and then cuts as near to the mean as that capacity allows. Slots are numbered within the parts of a unit; a unit is
divided by a hash of the row into parts of some 256 rows, or of 1/65,536 of all rows if that is more. So no task has to rank a
hot group alone, and a part holds no larger a share of more rows. All parts together are at most 65,536 more than
there are units, which is why their offsets may be broadcast.

Defined cases: null text has size 8 and the check sum of an empty text, and forms a group with empty texts. Repeated rows
and null ids are rows like any other; ties in the order of slots fall to equal rows only. Fewer units than shards leave
shards empty. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugemill.llm.common import materialize, table

SHARDS = 24
UNIT_BITS = 16
#: Rows of a part, unless there would be more parts than that.
PART_ROWS, MOST_PARTS = 256, 1 << 16


def fits(before: list[int], capacity: int, shards: int) -> bool:
    """Whether the greedy walk over sizes with the running sums before (from 0) stays within capacity and shards."""
    at, used, last = 0, 0, len(before) - 1
    while at < last:
        to = bisect_right(before, before[at] + capacity) - 1
        used += 1
        if to == at or used > shards:
            return False
        at = to
    return True


def smallest_capacity(sizes: list[int], shards: int) -> int:
    before = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-before[-1] // shards)]), before[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(before, mid, shards) else (mid + 1, high)
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit in turn: contiguous, the largest shard as small as can be, the others near the mean."""
    before, capacity, n = [0, *accumulate(sizes)], smallest_capacity(sizes, shards), len(sizes)
    needs = [0] * (n + 1)  # shards that the units from i on need
    for i in range(n - 1, -1, -1):
        needs[i] = 1 + needs[max(i + 1, bisect_right(before, before[i] + capacity) - 1)]
    out, at = [], 0
    for shard in range(shards):
        left = shards - shard
        most = bisect_right(before, before[at] + capacity) - 1
        goal = before[at] + (before[n] - before[at]) / left
        to = min(most, max(at, bisect_right(before, goal) - 1))
        if to < most and before[to + 1] - goal < goal - before[to]:
            to += 1
        while to < n and needs[to] > left - 1:
            to += 1
        out += [shard] * (to - at)
        at = to
    return out


def shard(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    digest = F.xxhash64(text)
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("_h"), F.shiftrightunsigned(digest, 64 - UNIT_BITS).cast("int").alias("_unit")), "shard-rows")
    units = {u: (n, size) for u, n, size in rows.groupBy("_unit").agg(F.count("*"), F.sum("size")).collect()}  # at most 2 ** UNIT_BITS
    part_rows = max(part_rows, -(-sum(n for n, _ in units.values()) // MOST_PARTS))
    parts = {u: -(-n // part_rows) for u, (n, _) in units.items() if n > part_rows}
    counts, part = {}, F.lit(0)
    if parts:
        divided = spark.createDataFrame(sorted(parts.items()), "_unit int, _parts int")
        rows = rows.join(F.broadcast(divided), "_unit", "left")
        part = F.pmod(F.xxhash64("doc_id", "_h"), F.coalesce("_parts", F.lit(1))).cast("int")
        counts = {(u, p): n for u, p, n in rows.where("_parts is not null").groupBy("_unit", part).count().collect()}  # at most MOST_PARTS and one for each unit
    order = sorted(units)
    offsets, filled = [], [0] * shards
    for u, s in zip(order, cut([units[u][1] for u in order], shards), strict=True):
        for p in range(parts.get(u, 1)):
            offsets.append((u, p, s, filled[s]))
            filled[s] += counts.get((u, p), 0) if u in parts else units[u][0]
    placed = spark.createDataFrame(offsets, "_unit int, _part int, shard int, _offset long")
    slot = F.row_number().over(Window.partitionBy("_unit", "_part").orderBy("_h", "doc_id")) - 1
    return rows.withColumn("_part", part).withColumn("_slot", slot).join(F.broadcast(placed), ["_unit", "_part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_offset") + F.col("_slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
