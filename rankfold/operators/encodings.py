"""Block encodings: sizes, fits, lossless round trips, and filters and sums on encoded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bits
from .ranking import with_rank


def blocks(df: DataFrame, size: int) -> DataFrame:
    """df (key, and what breaks ties) in the order of its columns, with rank, block_id and the place idx in the block."""
    ranked = with_rank(df, *df.columns)
    return ranked.withColumn("block_id", F.expr(f"rank div {size}")).withColumn("idx", F.expr(f"rank % {size}"))


def frame_of_reference(b: DataFrame) -> DataFrame:
    out = b.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return out.withColumn("bits", bits(F.col("hi") - F.col("lo")))


def deltas(b: DataFrame) -> DataFrame:
    """rank, block_id, idx, key, delta to the key before it in the block (0 for the first)."""
    before = F.lag("key").over(Window.partitionBy("block_id").orderBy("idx"))
    return b.withColumn("delta", F.coalesce(F.col("key") - before, F.lit(0)))


def undo_deltas(d: DataFrame) -> DataFrame:
    """The keys again, from a block's first key and the sums of deltas."""
    w = Window.partitionBy("block_id").orderBy("idx")
    return d.withColumn("decoded", F.first("key").over(w) + F.sum("delta").over(w))


def runs(df: DataFrame, value: str, order: str, part: str) -> DataFrame:
    """(part, run_start, value, n): run lengths of `value` in the order inside each part."""
    w = Window.partitionBy(part).orderBy(order)
    new = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    new = new.withColumn("_run", F.sum("_new").over(w))
    return new.groupBy(part, "_run").agg(F.min(order).alias("run_start"), F.first(value).alias("value"), F.count(F.lit(1)).alias("n")).drop("_run")


def line_fit(b: DataFrame) -> DataFrame:
    """Least squares per block of key - lo on idx."""
    lo = b.groupBy("block_id").agg(F.min("key").alias("lo"))
    rel = b.join(lo, "block_id").withColumn("y", (F.col("key") - F.col("lo")).cast("double"))
    return rel.groupBy("block_id", "lo").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", F.col("idx").cast("double")).alias("slope"), F.regr_intercept("y", F.col("idx").cast("double")).alias("intercept"))


def stored_line(fit: DataFrame) -> DataFrame:
    """(block_id, lo, slope, intercept) of line_fit(): all that a block's guesses need."""
    zero = F.lit(0.0)
    return fit.select("block_id", "lo", F.coalesce("slope", zero).alias("slope"), F.coalesce("intercept", zero).alias("intercept"))


def guessed(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows (block_id, idx) with the line's value at their place."""
    held = lines.select("block_id", F.col("lo").alias("_lo"), F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    guess = F.col("_lo") + F.floor(F.col("_intercept") + F.col("_slope") * F.col("idx")).cast("long")
    return rows.join(held, "block_id").withColumn("guess", guess).drop("_lo", "_slope", "_intercept")


def line_residuals(b: DataFrame, lines: DataFrame) -> DataFrame:
    """b with the residual of its key: what is stored beside `lines`, without the guess."""
    return guessed(b, lines).withColumn("residual", F.col("key") - F.col("guess")).drop("guess")


def line_keys(rows: DataFrame, lines: DataFrame, name: str = "key") -> DataFrame:
    """rows (block_id, idx, residual) with the key that they and the lines stand for."""
    return guessed(rows, lines).withColumn(name, F.col("guess") + F.col("residual")).drop("guess", "residual")


def entropy(df: DataFrame, value: str, part: str) -> DataFrame:
    counts = df.groupBy(part, value).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(part))
    p = F.col("c") / total
    return counts.withColumn("e", -p * F.log2(p)).groupBy(part).agg(F.round(F.sum("e"), 6).alias("entropy"))


def common_prefix(df: DataFrame, text: str, part: str) -> DataFrame:
    """Length of the prefix that the least and greatest, and so all, strings of a part share."""
    ends = df.groupBy(part).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    n = F.least(F.length("lo"), F.length("hi"))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("lo"), i, F.lit(1)) != F.substr(F.col("hi"), i, F.lit(1)))
    return ends.select(part, "lo", "hi", F.coalesce(F.get(differs, F.lit(0)) - 1, n).cast("long").alias("prefix"))
