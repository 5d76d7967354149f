"""Columns, keys, probes and operation streams made by formulas of row numbers, so that any engine can repeat them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import unit


def running_sum(df: DataFrame, of: str, by: str, name: str, group: int = 4096) -> DataFrame:
    """df with the sum of `of` over all rows up to each in the order of `by` (numbers from 0), in two levels."""
    df = df.withColumn("_g", F.expr(f"{by} div {group}"))
    sums = df.groupBy("_g").agg(F.sum(of).alias("_s"))
    # One row for each group.
    sums = sums.select("_g", F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum(of).over(Window.partitionBy("_g").orderBy(by))
    return df.join(F.broadcast(sums), "_g").withColumn(name, F.col("_base") + inside).drop("_g", "_base")


def linear(spark: SparkSession, n: int, step: int = 7, start: int = 100) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") * step + start).alias("value"))


def stepwise(spark: SparkSession, n: int, run: int = 10_000, noise: int = 3, seed: int = 5) -> DataFrame:
    """3 + 5 * i + noise, starting again every `run` rows."""
    wobble = F.floor(unit(F.col("id"), seed) * (2 * noise + 1)) - noise
    return spark.range(n).select("id", (3 + 5 * (F.col("id") % run) + wobble).cast("long").alias("value"))


def normal(spark: SparkSession, n: int, mean: float = 1e6, deviation: float = 1e5, seed: int = 7) -> DataFrame:
    """Two uniform numbers give one normal one, by its radius and angle."""
    radius = F.sqrt(-2 * F.log(unit(F.col("id"), seed)))
    value = mean + deviation * radius * F.cos(2 * math.pi * unit(F.col("id"), seed + 1))
    return spark.range(n).select("id", F.round(value).cast("long").alias("value"))


def arrivals(spark: SparkSession, n: int, mean: int = 1000, seed: int = 9) -> DataFrame:
    """Times of a Poisson process: sums of exponential gaps."""
    gaps = spark.range(n).withColumn("gap", F.round(-mean * F.log(unit(F.col("id"), seed))).cast("long"))
    return running_sum(gaps, "gap", "id", "value").select("id", "value")


def uniform_keys(spark: SparkSession, n: int, most: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.floor(unit(F.col("id"), seed) * most).cast("long").alias("key"))


def binomial_keys(spark: SparkSession, n: int, seed: int = 2) -> DataFrame:
    """Successes of 32 fair trials, the bits of one number."""
    return spark.range(n).select("id", F.bit_count(F.floor(unit(F.col("id"), seed) * float(1 << 32)).cast("long")).cast("long").alias("key"))


def geometric_keys(spark: SparkSession, n: int, p: float = 0.01, seed: int = 3) -> DataFrame:
    return spark.range(n).select("id", F.floor(F.log(unit(F.col("id"), seed)) / math.log(1 - p)).cast("long").alias("key"))


def ranges(ranks: DataFrame, keys: int, most: int = 100, seed: int = 13) -> DataFrame:
    """ranks (op_id, rank) with the last rank of a range of 0 to `most` keys from there."""
    length = F.floor(unit(F.col("op_id"), seed) * (most + 1)).cast("long")
    return ranks.withColumn("last", F.least(F.col("rank") + length, F.lit(keys - 1)))


def init_split(ranked: DataFrame, n_init: int, n: int, step: int = 7919) -> DataFrame:
    """ranked keys (key, rank from 0) dealt by the order of rank * step mod n: the first `n_init` load the store, the rest is inserted.

    A loaded key's value is its rank among the loaded ones; an inserted one's is null and `op_id` tells its turn.
    n must not be a multiple of the prime `step`.
    """
    from ..operators.ranking import with_rank

    dealt = ranked.select("key", (F.col("rank") * step % n).alias("turn"))
    load = with_rank(dealt.filter(F.col("turn") < n_init), "key", name="value").select("key", F.lit(True).alias("init"), "value", F.lit(None).cast("long").alias("op_id"))
    late = dealt.filter(F.col("turn") >= n_init).select("key", F.lit(False).alias("init"), F.lit(None).cast("long").alias("value"), (F.col("turn") - n_init).alias("op_id"))
    return load.unionByName(late)


def out_of_order(ranked: DataFrame, share: float = 0.1, delay: int = 50, seed: int = 21) -> DataFrame:
    """ranked (key, rank): a `share` of the rows arrive `delay` turns late; `turn` is the order of arrival, `late` tells which."""
    late = unit(F.col("rank"), seed) < share
    return ranked.select("key", "rank", late.alias("late"), (F.col("rank") * 2 + F.when(late, 2 * delay + 1).otherwise(0)).alias("turn"))


def probe_mix(spark: SparkSession, ranked: DataFrame, n: int, present: float, lo: int, hi: int, keys: int, seed: int = 31) -> DataFrame:
    """(op_id, probe): a share of present keys by rank, else any number of lo..hi."""
    ops = spark.range(n).select(F.col("id").alias("op_id"), (unit(F.col("id"), seed) < present).alias("here"), F.floor(unit(F.col("id"), seed + 1) * keys).cast("long").alias("rank"), (lo + F.floor(unit(F.col("id"), seed + 2) * (hi - lo + 1))).cast("long").alias("any"))
    return ops.join(ranked.select("rank", "key"), "rank").select("op_id", F.when(F.col("here"), F.col("key")).otherwise(F.col("any")).alias("probe"))


def code_of(op: Column) -> Column:
    """Operation codes as the binary streams hold them."""
    return F.when(op == "READ", 0).when(op == "UPDATE", 1).when(op == "SCAN", 2).when(op == "INSERT", 3).cast("int")
