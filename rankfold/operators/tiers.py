"""A two-tier table: hot rows by last access in one table, cold rows in pages of key-ordered files.

Rows arrive in the order of keys, or out of order into a side list that is sorted and merged on
reading.  Eviction keeps the `capacity` rows of the latest access, ties by the smaller key, and
writes the others as cold pages; a range search answers from both and tells where each row was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import asof, carried, with_rank


@dataclass(frozen=True)
class Tiered:
    hot: DataFrame  # key, value, last_access
    cold: DataFrame | None = None  # key, value, last_access, page_id
    late: DataFrame | None = None  # rows that came out of order
    capacity: int = 1 << 20
    per_page: int = 256

    def append(self, rows: DataFrame) -> Tiered:
        """Rows (key, value, last_access); those at or below the greatest key so far are out of order."""
        top = self.hot.agg(F.max("key").alias("top"))
        split = materialize(rows.join(F.broadcast(top)).withColumn("late", F.coalesce(F.col("key") <= F.col("top"), F.lit(False))).drop("top"), "arrived")
        late = split.filter("late").drop("late")
        late = late if self.late is None else self.late.unionByName(late)
        return replace(self, hot=self.hot.unionByName(split.filter("not late").drop("late")), late=late)

    def touch(self, accesses: DataFrame) -> Tiered:
        """accesses (key, at): the hot rows' last accesses move on."""
        last = accesses.groupBy("key").agg(F.max("at").alias("_at"))
        moved = self.hot.join(last, "key", "left").withColumn("last_access", F.greatest("last_access", F.coalesce("_at", "last_access"))).drop("_at")
        return replace(self, hot=moved)

    def evict(self) -> Tiered:
        """Side list merged, then all rows beyond the capacity go to cold pages."""
        rows = self.hot if self.late is None else self.hot.unionByName(self.late)
        order = with_rank(rows.withColumn("_o", -F.col("last_access")), "_o", "key", name="_r").drop("_o")
        order = materialize(order, "recency")
        out = order.filter(F.col("_r") >= self.capacity).drop("_r")
        if self.cold is not None:
            out = out.unionByName(self.cold.drop("page_id"))
        paged = with_rank(out, "key").withColumn("page_id", F.expr(f"rank div {self.per_page}")).drop("rank")
        cold = materialize(paged.repartitionByRange("key").sortWithinPartitions("key"), "cold")
        return replace(self, hot=materialize(order.filter(F.col("_r") < self.capacity).drop("_r"), "hot"), cold=cold, late=None)

    def between(self, low: int, high: int) -> DataFrame:
        """(key, value, tier, page_id) of the closed interval; tier is memory, late or disk."""
        inside = F.col("key").between(low, high)
        none = F.lit(None).cast("long").alias("page_id")
        out = self.hot.filter(inside).select("key", "value", F.lit("memory").alias("tier"), none)
        if self.late is not None:
            out = out.unionByName(self.late.filter(inside).select("key", "value", F.lit("late").alias("tier"), none))
        if self.cold is not None:
            out = out.unionByName(self.cold.filter(inside).select("key", "value", F.lit("disk").alias("tier"), "page_id"))
        return out


def segment_buffers(segments: DataFrame, inserts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Inserts (key, value) filed in the buffer of the segment (first_key) that covers them.

    Returns (inserts with first_key; buffers: first_key, n, full): a full buffer asks for its segment to be fitted anew.
    Keys before the first segment go to that one.
    """
    least = segments.agg(F.min("first_key").alias("_least"))
    filed = asof(inserts, segments, "key", "first_key", []).join(F.broadcast(least))
    filed = materialize(filed.select("key", "value", F.coalesce("found_key", "_least").alias("first_key")), "filed")
    sizes = filed.groupBy("first_key").agg(F.count(F.lit(1)).alias("n"))
    return filed, sizes.withColumn("full", F.col("n") > most)


def latest_writes(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads (op_id, key) with the value of the latest write (at, key, value) of the key before the op.

    Both are sorted by (key, at) together, so the operations of one hot key spread over several ranges.
    """
    w = writes.select("key", "at", F.lit(0).alias("kind"), F.struct("key", "value").alias("w"))
    r = reads.select("key", F.col("op_id").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(w.schema["w"].dataType).alias("w"))
    found = carried(w.unionByName(r), ["key", "at", "kind"], "w").filter("kind = 1")
    return found.select(F.col("at").alias("op_id"), "key", F.when(F.col("_found.key") == F.col("key"), F.col("_found.value")).alias("value"))
