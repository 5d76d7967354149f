"""A versioned buffer-and-static store: newest-wins upserts, tombstones, levels and merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tiers import latest_writes

COLUMNS = ("key", "value", "seq", "deleted")


def newest(*levels: DataFrame) -> DataFrame:
    """One row per key, that of the greatest seq; a partial maximum, so no key is gathered whole."""
    rows = levels[0].select(*COLUMNS)
    for x in levels[1:]:
        rows = rows.unionByName(x.select(*COLUMNS))
    top = rows.groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("t"))
    return top.select("key", "t.value", "t.seq", "t.deleted")


def live(*levels: DataFrame) -> DataFrame:
    return newest(*levels).filter(~F.col("deleted"))


def split(ranked: DataFrame, n: int, buffered: int = 100) -> DataFrame:
    """Every (n div buffered)-th record goes to the buffer, the first `buffered` of them; the rest is static."""
    step = max(1, n // buffered)
    return ranked.withColumn("in_buffer", (F.col("rank") % step == 0) & (F.expr(f"rank div {step}") < buffered))


def budget_rows(budget_bytes: int, model_bytes: int, record_bytes: int = 16) -> int:
    """Rows that a buffer may hold: what the model of the static part leaves of the budget."""
    if budget_bytes <= model_bytes:
        raise ValueError(f"a budget of {budget_bytes} bytes does not hold a model of {model_bytes}")
    return (budget_bytes - model_bytes) // record_bytes


def update_existing(static: DataFrame, changes: DataFrame) -> DataFrame:
    """static (key, value) with the values of changes (key, new_value) whose keys exist."""
    return static.join(changes, "key", "left").select("key", F.coalesce("new_value", "value").alias("value"), F.col("new_value").isNotNull().alias("updated"))


def merge_partitions(static: DataFrame, delta: DataFrame, parts: int) -> DataFrame:
    """The merge of live rows, range-partitioned so that each task writes one slice in order."""
    return live(static, delta).repartitionByRange(parts, "key").sortWithinPartitions("key")


@dataclass
class Store:
    """Versions are immutable tables; a merge writes the next one and only then the name moves on."""

    static: DataFrame
    buffer: DataFrame | None = None
    version: int = 0
    budget_rows: int = 1 << 20

    def apply(self, changes: DataFrame) -> Store:
        """changes (COLUMNS) on top; a buffer above the budget is merged."""
        buffer = materialize(newest(changes, self.buffer) if self.buffer is not None else newest(changes), "buffer")
        if buffer.count() <= self.budget_rows:
            return Store(self.static, buffer, self.version, self.budget_rows)
        return Store(self.static, buffer, self.version, self.budget_rows).merge()

    def merge(self) -> Store:
        if self.buffer is None:
            return self
        merged = materialize(live(self.static, self.buffer).repartitionByRange("key").sortWithinPartitions("key"), "static")
        return Store(merged, None, self.version + 1, self.budget_rows)

    def rows(self) -> DataFrame:
        return live(self.static, self.buffer) if self.buffer is not None else live(self.static)


def reads_as_of(initial: DataFrame, ops: DataFrame) -> DataFrame:
    """(op_id, key, value) of READ ops: the latest write of the key before the op, else its initial value."""
    writes = ops.filter("op in ('INSERT', 'UPDATE')").select("key", F.col("op_id").alias("at"), "value")
    first = initial.select("key", F.lit(-1).cast("long").alias("at"), "value")
    return latest_writes(ops.filter("op = 'READ'").select("op_id", "key"), writes.unionByName(first))
