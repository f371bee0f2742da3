"""Sharding: contiguous shards whose largest is as small as it can be.

Documents with equal texts are one atomic group. Groups stand in the order of a
64-bit hash of their text; a shard is a contiguous run of groups. The driver
searches the smallest feasible capacity by bisection and checks each capacity
greedily. It holds one row for each of about sqrt(n) hash ranges, and fetches
the groups of a range only where a cut falls into it.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import root_bits, written


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the end of the record; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


class _Groups:
    """Group sizes in key order, seen through sums by hash range."""

    def __init__(self, groups: DataFrame, bits: int):
        self.groups, self.shift = groups, 64 - bits
        rows = groups.groupBy(F.shiftright("__key", self.shift).alias("r")).agg(F.sum("__size").alias("s"), F.max("__size").alias("m")).orderBy("r").collect()
        self.ranges = [r["r"] for r in rows]
        self.ends = list(accumulate(r["s"] for r in rows))
        self.total = self.ends[-1] if rows else 0
        self.largest = max((r["m"] for r in rows), default=0)
        self._fetched: dict[int, tuple[list[int], list[int]]] = {}

    def _inside(self, i: int) -> tuple[list[int], list[int]]:
        """Keys of range ``i`` and the sum of sizes up to and with each."""
        if i not in self._fetched:
            low = self.ranges[i] << self.shift
            high = low + (1 << self.shift) - 1
            rows = self.groups.where(F.col("__key").between(low, high)).orderBy("__key").collect()
            before = self.ends[i - 1] if i else 0
            self._fetched[i] = [r["__key"] for r in rows], list(accumulate((r["__size"] for r in rows), initial=before))[1:]
        return self._fetched[i]

    def reach(self, limit: int) -> tuple[int, int | None]:
        """The largest sum of leading groups that is at most ``limit``, and the first key beyond."""
        i = bisect_right(self.ends, limit)
        if i == len(self.ends):
            return self.total, None
        keys, sums = self._inside(i)
        j = bisect_right(sums, limit)
        return (sums[j - 1] if j else (self.ends[i - 1] if i else 0)), keys[j]


def minimax_cuts(groups: _Groups, shards: int) -> list[int]:
    """First keys of shards 1, 2, ... for the smallest feasible capacity."""

    def cuts(capacity: int) -> list[int] | None:
        at, found = 0, []
        for _ in range(shards):
            at, key = groups.reach(at + capacity)
            if key is None:
                return found
            found.append(key)
        return None

    low = max(groups.largest, -(-groups.total // shards))
    high = low + groups.largest
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if cuts(mid) is not None else (mid + 1, high)
    return cuts(low) or []


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their columns, then ``__size``, ``__crc32``, ``__shard``, ``__slot``.

    Shards are numbered from 0, slots in a shard from 0 without gaps. Null texts
    are one group of size 1 each; an empty text has size 1 too. Repeated rows
    get a slot each. An empty table gives an empty result; with fewer groups
    than shards the last shards are empty. Other columns pass through; names
    that begin with two underscores are reserved.
    """
    keyed = docs.withColumns({"__key": F.xxhash64(text_col), "__size": text_size(F.col(text_col)), "__crc32": F.crc32(F.coalesce(F.col(text_col), F.lit("")))})
    groups = written(keyed.groupBy("__key").agg(F.sum("__size").alias("__size"), F.count(F.lit(1)).alias("__rows")).repartitionByRange("__key").sortWithinPartitions("__key"), "shard-groups")
    rows = groups.agg(F.sum("__rows")).first()[0] or 0
    bits = root_bits(rows, 8)
    cuts = minimax_cuts(_Groups(groups, bits), shards)
    shard = F.lit(0)
    for i, key in enumerate(cuts, 1):
        shard = F.when(F.col("__key") >= key, i).otherwise(shard)
    # Slots: documents are dealt by a hash of their id, so a large group of equal texts is dealt too.
    dealt = keyed.withColumns({"__shard": shard, "__cell": F.shiftrightunsigned(F.xxhash64(id_col), 64 - bits)})
    ahead = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__shard", "__cell").agg(F.count(F.lit(1)).alias("__n")).select("__shard", "__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__shard", "__cell").orderBy(F.col(id_col), "__crc32", "__size")
    placed = dealt.withColumn("__slot", F.row_number().over(within) - 1)
    return placed.join(starts, ["__shard", "__cell"]).withColumn("__slot", F.col("__slot") + F.col("__start")).select(*(F.col(f"`{c}`") for c in docs.columns), "__size", "__crc32", "__shard", "__slot")


def op7_sharding(docs: DataFrame) -> DataFrame:
    """The digest of ``shard_documents`` with 8 shards under the law ``bytes``."""
    out = shard_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
