"""Keys, probes and operation logs made by formulas, so that any engine can repeat them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import unit


def uniform_ranks(spark: SparkSession, n: int, keys: int, step: int = 7919) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("op_id"), (F.col("id") * step % keys).alias("rank"))


def zipf_ranks(spark: SparkSession, n: int, keys: int, theta: float = 0.99, seed: int = 1, scrambled: bool = False) -> DataFrame:
    """Ranks in [0, keys): the continuous inverse of the Zipf distribution, the most frequent first or scrambled."""
    top = keys ** (1 - theta)
    rank = F.least(F.floor(F.pow(unit(F.col("id"), seed) * (top - 1) + 1, F.lit(1 / (1 - theta)))) - 1, F.lit(keys - 1)).cast("long")
    if scrambled:
        rank = (rank * 2654435761 + 12345) % keys
    return spark.range(n).select(F.col("id").alias("op_id"), rank.alias("rank"))


def hotspot_ranks(spark: SparkSession, n: int, keys: int, hot_keys: float = 0.2, hot_ops: float = 0.9, seed: int = 1) -> DataFrame:
    hot = math.ceil(keys * hot_keys)
    u = unit(F.col("id"), seed + 1)
    rank = F.when(unit(F.col("id"), seed) < hot_ops, F.floor(u * hot)).otherwise(hot + F.floor(u * (keys - hot)))
    return spark.range(n).select(F.col("id").alias("op_id"), F.least(rank, F.lit(keys - 1)).cast("long").alias("rank"))


def mix(spark: SparkSession, n: int, keys: int, kind: str) -> DataFrame:
    """ops (op_id, op, key, value, len): `c` reads, `cc` inserts, `aa` half of each, `s` with scans and updates."""
    k = F.col("id") * 7919 % keys
    op = {
        "c": F.lit("READ"),
        "cc": F.lit("INSERT"),
        "aa": F.when(F.col("id") % 2 == 0, "READ").otherwise("INSERT"),
        "s": F.when(F.col("id") % 4 == 0, "READ").when(F.col("id") % 4 == 1, "UPDATE").when(F.col("id") % 4 == 2, "SCAN").otherwise("INSERT"),
    }[kind]
    ops = spark.range(n).select(F.col("id").alias("op_id"), op.alias("op"), F.when(op == "INSERT", keys + k).otherwise(k).alias("key"))
    value = F.when(F.col("op").isin("INSERT", "UPDATE"), F.col("op_id") * 10)
    return ops.select("op_id", "op", "key", value.alias("value"), F.when(F.col("op") == "SCAN", (F.col("op_id") % 100 + 1).cast("int")).alias("len"))


def hard_keys(spark: SparkSession, n: int, local: int, broad: int, piece: int = 64, seed: int = 11) -> DataFrame:
    """(id, key): n ascending keys in pieces of `piece` with one gap each.

    A piece's gap is that of its stretch of 64 pieces, from 1 to 2^broad, times its own factor from 1
    to 2^local, so `broad` sets how hard the keys are at large errors and `local` at small ones.
    """
    def draw(c, salt: int, top: int):
        return F.pow(F.lit(2.0), unit(c, seed + salt) * top)

    at = spark.range(-(-n // piece)).select(F.col("id").alias("p"), F.expr("id div 64").alias("stretch"))
    at = at.withColumn("gap", F.ceil(draw(F.col("stretch"), 0, broad) * draw(F.col("p"), 1, local)).cast("long"))
    stretches = at.groupBy("stretch").agg((F.sum("gap") * piece).alias("s"))
    # One row for each 4,096 keys; ranges of 1,024 stretches get their offsets from one row each.
    stretches = stretches.withColumn("g", F.expr("stretch div 1024"))
    g = stretches.groupBy("g").agg(F.sum("s").alias("gs"))
    g = g.select("g", F.coalesce(F.sum("gs").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g").orderBy("stretch")
    stretches = stretches.join(g, "g").select("stretch", (F.col("base") + F.sum("s").over(inside) - F.col("s")).alias("base"))
    w = Window.partitionBy("stretch").orderBy("p")
    starts = at.join(stretches, "stretch").select("p", "gap", (F.col("base") + (F.sum("gap").over(w) - F.col("gap")) * piece).alias("first"))
    keys = spark.range(n).select("id", F.expr(f"id div {piece}").alias("p"), F.expr(f"id % {piece}").alias("i"))
    return keys.join(starts, "p").select("id", (F.col("first") + F.col("i") * F.col("gap")).cast("long").alias("key"))
