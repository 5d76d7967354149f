"""Leaves that split as they fill: key-ordered rows in leaves of bounded size, found through their least keys.

A bulk load deals sorted rows to leaves of `fill` of their capacity.  An insert routes rows to
leaves, newest row of a key first, and cuts every leaf above its capacity into leaves of `fill`
again, by ranks over all rows to cut, so that a leaf that takes many rows at once is no task of its
own.  Leaves are written tables of a version; older versions stay readable.

Defined results: an empty table has no leaves, and its first insert is a bulk load; keys below the
first leaf go to it; of rows with equal keys in a batch the greatest value counts; null keys are
left out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import asof, with_rank


@dataclass(frozen=True)
class Leaves:
    rows: DataFrame  # key, value, leaf (the leaf's least key when it was made)
    capacity: int = 256
    fill: float = 0.7
    splits: int = 0

    @staticmethod
    def load(rows: DataFrame, capacity: int = 256, fill: float = 0.7) -> Leaves:
        """rows (key, value), keys distinct."""
        return Leaves(_dealt(rows.filter("key is not null").withColumn("g", F.lit(0).cast("long")), capacity, fill), capacity, fill)

    def leaves(self) -> DataFrame:
        """(leaf, lo, hi, n)."""
        return self.rows.groupBy("leaf").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))

    def _routed(self, rows: DataFrame) -> DataFrame:
        """rows with the leaf that their key belongs to."""
        made = self.rows.select("leaf").distinct()
        first = made.agg(F.min("leaf").alias("_first"))
        found = asof(rows, made, "key", "leaf", []).join(F.broadcast(first))
        return found.withColumn("leaf", F.coalesce("found_key", "_first")).drop("found_key", "_first")

    def insert(self, batch: DataFrame) -> Leaves:
        """batch (key, value) replaces and adds rows; leaves above their capacity are cut."""
        new = batch.filter("key is not null").groupBy("key").agg(F.max("value").alias("value"))
        if self.rows.isEmpty():
            return Leaves.load(new, self.capacity, self.fill)
        stay = self.rows.join(new.select("key"), "key", "left_anti")
        every = materialize(stay.select("key", "value", "leaf").unionByName(self._routed(new).select("key", "value", "leaf")), "leaves")
        full = materialize(every.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.capacity).select("leaf"), "full")
        n = full.count()
        if not n:
            return replace(self, rows=every)
        cut = _dealt(every.join(full, "leaf", "left_semi").select("key", "value", F.col("leaf").alias("g")), self.capacity, self.fill)
        return replace(self, rows=materialize(every.join(full, "leaf", "left_anti").unionByName(cut), "leaves"), splits=self.splits + n)

    def erase(self, low: int, high: int) -> Leaves:
        """Without the keys of [low, high); a leaf that loses all its rows is gone."""
        return replace(self, rows=materialize(self.rows.filter((F.col("key") < low) | (F.col("key") >= high)), "leaves"))

    def find(self, probes: DataFrame) -> DataFrame:
        """(probe, value), null on a miss: a probe reads its leaf only."""
        at = self._routed(probes.select(F.col("probe").alias("key")).distinct())
        hits = at.join(self.rows, ["leaf", "key"]).select(F.col("key").alias("probe"), "value")
        return probes.select("probe").join(hits, "probe", "left")


def _dealt(rows: DataFrame, capacity: int, fill: float) -> DataFrame:
    """rows (key, value, g) cut into leaves inside each g."""
    each = max(1, int(capacity * fill))
    ranked = materialize(with_rank(rows, "g", "key"), "to-cut")
    base = ranked.groupBy("g").agg(F.min("rank").alias("_base"))
    cut = ranked.join(base, "g").withColumn("_part", F.expr(f"(rank - _base) div {each}"))
    least = cut.groupBy("g", "_part").agg(F.min("key").alias("leaf"))
    return materialize(cut.join(least, ["g", "_part"]).select("key", "value", "leaf"), "leaves")
