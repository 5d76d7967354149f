"""Global ranks, pages and predecessor search without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def placed(df: DataFrame, *by: str) -> DataFrame:
    """df range-partitioned and sorted by `by`, written, with its place: _part, and _at in the order of all rows.

    Ranges are as many as the shuffle asks for at the size of the data, and `by` may go on past the
    key with columns that break ties, so that rows of one hot key spread over several ranges.
    """
    out = df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return materialize(out.withColumn("_part", F.shiftright("_at", 33)), "placed")


def with_rank(df: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """df in the order of `by` with its 0-based rank.

    Two passes: a range partitioning sorted inside its partitions, whose row ids hold partition
    and place; then the counts of the partitions, one row each, give every partition's offset.
    """
    rows = placed(df, *by)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_base"))
    # One row for each partition of a single job: at most some 100,000 of 16 bytes.
    out = rows.join(F.broadcast(sizes), "_part")
    rank = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, rank).drop("_at", "_part", "_base")


def with_pages(ranked: DataFrame, per_page: int, pages_per_file: int = 16) -> DataFrame:
    page = F.expr(f"rank div {per_page}")
    return ranked.withColumn("page_id", page).withColumn("file_id", F.expr(f"rank div {per_page * pages_per_file}"))


def zones(paged: DataFrame, key: str = "key", group: str = "page_id") -> DataFrame:
    return paged.groupBy(group).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))


def carried(rows: DataFrame, order: list[str], value: str, name: str = "_found") -> DataFrame:
    """rows with the last non-null `value` at or before each in the order of all rows.

    A window runs inside each range; what reaches in from earlier ranges is the last value of
    each, one row a range, carried on.
    """
    at = placed(rows, *order)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tops = at.filter(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, "_at").alias("_top"))
    every = at.select("_part").distinct().join(tops, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select("_part", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    out = at.withColumn(name, F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(carry), "_part", "left")
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_at", "_part", "_carry")


def asof(probes: DataFrame, data: DataFrame, probe: str, key: str, payload: list[str], strict: bool = False) -> DataFrame:
    """probes with the payload of the greatest data.key <= probe (< if strict), or nulls.

    Both sides are sorted together.  Of equal keys the row with the greatest payload counts; null
    probes find nothing, null keys are never found.
    """
    row = F.struct(F.col(key).alias("_k"), *payload)
    held = data.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(1 if strict else 0).alias("_kind"), row.alias("_row"))
    asked = probes.select(F.col(probe).alias("_key"), F.lit(0 if strict else 1).alias("_kind"), F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"))
    both = held.withColumn("_probe", F.lit(None).cast(asked.schema["_probe"].dataType)).unionByName(asked.withColumn("_row", F.lit(None).cast(held.schema["_row"].dataType)))
    out = carried(both, ["_key", "_kind", "_row", "_probe"], "_row").filter("_probe is not null").select("_probe.*", F.col("_found").alias("_r"))
    return out.select(*probes.columns, F.col("_r._k").alias("found_key"), *[F.col(f"_r.{c}") for c in payload])


def pages_between(low: str, high: str, per_page: int) -> Column:
    return F.expr(f"({high} div {per_page}) - ({low} div {per_page}) + 1")
