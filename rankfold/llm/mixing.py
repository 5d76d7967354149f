"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is a shuffled stream of words that starts again at its end, up to `most` times, and
stops at its target; it is cut into blocks of `block_words`, which run on over the end of an epoch,
so only the last block of a source may be shorter.  Slot k of the mix maps the golden-ratio point
frac(k / phi) through the cumulative numbers of blocks to a source; the slots of a source are
ranked, and rank r takes block r.  Points go on until each source has all its blocks, so that every
source gets the whole words of its target exactly, however small it is.  DataFrame operations only.

Defined results: null text has size 0; null source is a source of its own, last in the order;
a source without words has target 0; repeated rows are mixed as separate documents; an empty
table gives an empty result.  Only the named columns are read, so others may clash freely, except
that `keep` must not name a column of the result.  Sources are expected to be few: their targets
and running sums are windows over one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, Scratch, table

#: The golden ratio's fraction in 52 bits, as two halves of 26, so that products stay below 2^63.
BITS = 26
STEP_HIGH, STEP_LOW = divmod(round(0.6180339887498949 * (1 << 2 * BITS)), 1 << BITS)
#: Points for each slot that is needed: by the three-distance theorem n points leave no gap above 1.9 / n.
POINTS = 2
#: Grid cells that turn the search in the cumulative weights into an equi-join.
CELLS = 4096
#: Slots ranked by one window; the offsets of runs come from their counts.
RUN = 1 << 16


@dataclass
class Mix:
    documents: DataFrame  # sid, bucket, rn (identify a row), key (see row_key()), doc_id, size, source_size, target
    sources: DataFrame  # sid, source, source_size, target, quota (whole words of it), n_blocks
    slots: DataFrame  # slot, sid, block
    pieces: DataFrame  # slot, epoch, sid, bucket, rn, doc_id, start_word, n_words


def golden_point(k):
    """frac(k / phi) of a long column, in 52 bits."""
    low, half = F.lit((1 << BITS) - 1), F.lit(1 << BITS)
    kl, kh = k.bitwiseAND(low), F.shiftright(k, BITS)
    top = (kl * STEP_HIGH + kh * STEP_LOW).bitwiseAND(low)
    return (top * half + kl * STEP_LOW).bitwiseAND(F.lit((1 << 2 * BITS) - 1)) / F.lit(float(1 << 2 * BITS))


def row_key(seed: int, doc_id, text):
    """A hash of a row; repeated rows share it."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets for `sizes` (source, source_size, n_docs).

    Water filling: a target is min(most * size, weight * level) with one level for all, which is
    what resharing the excess by weight, again and again, ends in.  Sources are one row each.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") % len(weights)) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy()
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(rest),
    )
    # The level of the first source that is not filled to its cap holds for all after it.
    full = F.col("cap") <= F.col("weight") * F.col("level")
    ranked = ranked.withColumn("level", F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("cap") <= F.col("weight") * F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level"))
    return ranked.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block_words: int = 128,
    docs_per_bucket: int = 1_000,
    seed: int = 17,
    keep=(),
    scratch: Scratch | None = None,
) -> Mix:
    """The schedule and the pieces of documents that it takes; see the module for its rules.

    The columns `keep` go along with the rows of `documents`.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        *keep,
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(seed, F.col(id_col), F.col(text_col)).alias("key"),
    )
    sized = scratch.save(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = source_targets(sizes, weights, share, float(most))
    # A target that rounding left just below a whole number is that number.
    sources = sources.withColumn("quota", F.floor(F.col("target") + 1e-6).cast("long"))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    sources = scratch.save(sources.coalesce(1), "sources")
    n_slots, n_docs = sources.agg(F.sum("n_blocks"), F.sum("n_docs")).first()
    n_buckets = max(1, -(-(n_docs or 0) // docs_per_bucket))

    # Slots: point -> grid cell -> source, then the rank in the source.
    high = F.sum("n_blocks").over(Window.orderBy("sid")) / F.sum("n_blocks").over(Window.partitionBy())
    cells = sources.filter("n_blocks > 0").withColumn("high", high)
    cells = cells.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("sid")))
    cells = cells.select(
        "sid", "n_blocks", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    slots = spark.range(POINTS * (n_slots or 0) + (64 if n_slots else 0)).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(F.broadcast(cells), "cell")
    slots = slots.filter("u >= low and u < high").select("slot", "sid", "n_blocks", F.floor(F.col("slot") / RUN).alias("run"))
    slots = scratch.save(slots, "slots")
    runs = slots.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("sid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    slots = slots.withColumn("in_run", rank).join(runs, ["sid", "run"]).withColumn("block", F.col("in_run") + F.col("base"))
    slots = slots.filter(F.col("block") < F.col("n_blocks")).select("slot", "sid", "block")

    # Documents: word offsets in the shuffled stream of their source, by a two-level prefix sum.
    placed = sized.join(sources.select("sid", "source_size", "target", "quota", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("sid", "doc_id", "source", *keep, "size", "source_size", "target", "quota", "key", F.pmod("key", F.lit(n_buckets)).alias("bucket"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    placed = placed.withColumn("rn", F.row_number().over(inside))
    placed = placed.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    buckets = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(buckets, ["sid", "bucket"]).withColumn("first", F.col("base") + F.col("before"))
    placed = scratch.save(placed.drop("base", "before"), "placed")
    # A document has a place in every epoch that begins before its source's quota is filled.
    cut = placed.filter("size > 0").select(
        "sid", "bucket", "rn", "doc_id", "size", "quota", F.col("first"), F.col("source_size"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")
    )
    cut = cut.withColumn("begin", F.col("first") + F.col("epoch") * F.col("source_size")).filter("begin < quota")
    cut = cut.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    start = F.greatest(F.col("block") * block_words, F.col("begin"))
    stop = F.least((F.col("block") + 1) * block_words, F.col("end"))
    pieces = cut.join(slots, ["sid", "block"]).select(
        "slot", "epoch", "sid", "bucket", "rn", "doc_id", (start - F.col("begin")).alias("start_word"), (stop - start).alias("n_words")
    )
    return Mix(placed, sources, slots, pieces)


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; sid, bucket and rn tell rows apart."""
    taken = mix.pieces.groupBy("sid", "bucket", "rn").agg(F.sum("n_words").alias("taken"))
    out = mix.documents.join(taken, ["sid", "bucket", "rn"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, sf_dir, "documents")))
