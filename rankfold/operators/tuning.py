"""Choosing parameters: errors, block sizes, budgets; models on samples of keys; radix tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bits
from ..session import materialize
from .packed import minimax_slope
from .ranking import asof, with_pages, zones

#: Granules that granule_lookup() names by one row.
GRANULE_BAND = 64


def least_errors(ranked: DataFrame, size: int) -> DataFrame:
    """(block_id, n, slope, error) of runs of `size` keys: the least error of one line through their ranks.

    The line with the least largest error over unevenly spaced keys: its slope is found by bisection,
    since the height of the points over a line is convex in the slope.
    """
    arrays = ranked.groupBy(F.expr(f"rank div {size}").alias("block_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("k"))

    def made(batches):
        for batch in batches:
            out = []
            for b, k in zip(batch.column("block_id").to_pylist(), batch.column("k").to_pylist(), strict=True):
                x = np.array([r["key"] - k[0]["key"] for r in k], float)
                y = np.arange(len(k), dtype=float)
                slope = line_slope(x, y)
                r = y - slope * x
                out.append((b, len(k), slope, float((r.max() - r.min()) / 2)))
            yield pa.RecordBatch.from_pylist([dict(zip(("block_id", "n", "slope", "error"), r, strict=True)) for r in out], pa.schema([("block_id", pa.int64()), ("n", pa.int64()), ("slope", pa.float64()), ("error", pa.float64())]))

    return arrays.select("block_id", "k").mapInArrow(made, "block_id long, n long, slope double, error double")


def line_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The slope of the line with the least largest error; x ascends, repeated values allowed."""
    if x[-1] == x[0]:
        return 0.0
    if np.array_equal(x, np.arange(len(x))):
        return minimax_slope(y)
    steps = np.diff(x) > 0
    rise = np.diff(y)[steps] / np.diff(x)[steps]
    span = (y[-1] - y[0]) / (x[-1] - x[0])
    low, high = min(0.0, float(rise.min())), max(float(rise.max()), span) * 2 + 1e-300
    for _ in range(200):
        s = (low + high) / 2
        r = y - s * x
        i, j = int(r.argmax()), int(r.argmin())
        if x[i] == x[j]:
            break
        low, high = (s, high) if x[i] > x[j] else (low, s)
    return (low + high) / 2


def reference_sizes(ranked: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, n_bytes): what blocks of each size take by frame of reference; sizes are multiples of the first.

    Keys are aggregated once, at the smallest size; larger blocks come from those.
    """
    least = sizes[0]
    small = ranked.groupBy(F.expr(f"rank div {least}").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    grid = small.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    big = grid.groupBy("size", F.expr(f"b * {least} div size").alias("block")).agg(F.sum("n").alias("n"), bits(F.max("hi") - F.min("lo")).alias("bits"))
    return big.groupBy("size").agg(F.sum(F.expr("(n * bits + 7) div 8 + 9")).alias("n_bytes"))


def page_grid(ranked: DataFrame, fixes: list[int], slides: list[int], records: int) -> DataFrame:
    """(fix, slide, pages, n_bytes): zone maps whose separator may be any value within `slide` pages after `fix` fixed ones.

    A group of fix + slide pages keeps one separator; its first `fix` pages are always read.  Bytes
    are 8 a separator and 4 for each page that a miss of the separator reads, on average half the slide.
    """
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("fix"), F.lit(s).alias("slide")) for f in fixes for s in slides if f + s]))
    grid = n.select("n", pairs.alias("p")).select("n", "p.fix", "p.slide")
    groups = F.expr(f"(n + (fix + slide) * {records} - 1) div ((fix + slide) * {records})")
    return grid.withColumn("pages", groups).select("fix", "slide", "pages", (F.col("pages") * 8 + F.expr("pages * slide * 4 div 2")).alias("n_bytes"))


def power_law(counts: list[tuple[float, float]]) -> tuple[float, float]:
    """(a, b) of n = a * eps^b by least squares in logarithms."""
    x, y = np.log([e for e, _ in counts]), np.log([n for _, n in counts])
    b = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    return float(np.exp(y.mean() - b * x.mean())), b


def error_for_space(a: float, b: float, most_bytes: float, segment_bytes: int = 16) -> float:
    """The least error whose model takes at most `most_bytes`, by Newton's method on a * eps^b * segment_bytes - most_bytes."""
    eps = 1.0
    for _ in range(200):
        f = a * eps**b * segment_bytes - most_bytes
        step = f / (a * b * eps ** (b - 1) * segment_bytes)
        new = max(eps / 2, eps - step)
        if abs(new - eps) <= 1e-12 * eps:
            break
        eps = new
    return eps


def error_for_time(most_pages: float, per_page: int) -> float:
    """The greatest error whose search window of 2 * eps + 2 records reaches over at most `most_pages` pages."""
    return float(max(0, math.floor(((most_pages - 1) * per_page - 2) / 2)))


def tune(counts: list[tuple[float, float]], most_bytes: float, most_pages: float, per_page: int = 256) -> dict:
    """The error for a space and for a time budget from measured (eps, segments)."""
    a, b = power_law(counts)
    return {"a": a, "b": b, "space_eps": error_for_space(a, b, most_bytes), "time_eps": error_for_time(most_pages, per_page)}


def granule_ends(ranked: DataFrame, granule: int) -> DataFrame:
    """The first and last key of each granule with its number as rank: what a model of granules is trained on.

    Where a key fills granules, keys after it lie in the last of them and not near its first: the next integer stands for them.
    """
    n = ranked.agg(F.max("rank").alias("_n"))
    ends = ranked.join(F.broadcast(n)).filter((F.col("rank") % granule).isin(0, granule - 1) | (F.col("rank") == F.col("_n")))
    ends = ends.select("key", F.expr(f"rank div {granule}").alias("rank"))
    runs = ends.groupBy("key").agg(F.min("rank").alias("_first"), F.max("rank").alias("rank")).filter(f"rank > _first + 1 and key < {(1 << 63) - 1}")
    return ends.unionByName(runs.select((F.col("key") + 1).alias("key"), "rank"))


def granule_lookup(ranked: DataFrame, probes: DataFrame, model: DataFrame, granule: int) -> DataFrame:
    """(probe, rank) through a model of granules (SEGMENT): the window is its error and one granule more on either side."""
    found = asof(probes, model, "probe", "first_key", ["slope", "first_rank", "last_rank", "max_err"]).filter("found_key is not null")
    guess = F.col("first_rank") + F.floor(F.col("slope") * (F.col("probe") - F.col("found_key"))).cast("long")
    low = F.least(F.greatest(guess - F.col("max_err") - 1, F.col("first_rank") - 1), F.col("last_rank"))
    high = F.greatest(F.least(guess + F.col("max_err") + 1, F.col("last_rank") + 1), F.col("first_rank"))
    # One row for each band of granules that a window meets, not for each granule: a window of 2 * max_err + 3
    # granules is some twenty times the probes.  Merged, never broadcast: probes grow with the data.
    band = f"div {GRANULE_BAND}"
    window = found.select("probe", F.greatest(low, F.lit(0)).alias("low"), high.alias("high"))
    wanted = window.withColumn("band", F.explode(F.expr(f"sequence(low {band}, high {band})"))).hint("merge")
    paged = with_pages(ranked, granule).select(F.col("key").alias("probe"), F.expr(f"page_id {band}").alias("band"), "page_id", "rank")
    hits = wanted.join(paged, ["probe", "band"]).filter("page_id between low and high").groupBy("probe").agg(F.min("rank").alias("rank"))
    # The ranks found grow with the probes too: merged, although their rows may be few enough for a broadcast.
    return probes.join(hits.hint("merge"), "probe", "left").select("probe", "rank")


def radix_table(model: DataFrame, prefix_bits: int = 12) -> tuple[DataFrame, int, int]:
    """(prefix, first_key, ...) rows: the segments that keys of each prefix can lie in; with the least key and the shift.

    A prefix is the top bits of key - least key; a segment is filed under each prefix from its own
    to the next segment's, so the table has at most 2^prefix_bits rows more than the model.
    """
    lo, hi = model.agg(F.min("first_key"), F.max("first_key")).first()
    lo, hi = lo or 0, hi or 0
    shift = max(0, (hi - lo).bit_length() - prefix_bits)
    ends = asof(model.select(F.col("first_key").alias("_f"), (-F.col("first_key")).alias("_down")), model.select((-F.col("first_key")).alias("_k"), F.col("first_key").alias("_next")), "_down", "_k", ["_next"], strict=True)
    last = F.shiftright(F.coalesce(F.col("_next"), F.lit(hi)) - lo, shift)
    held = model.join(ends.select("_f", "_next"), F.col("first_key") == F.col("_f"))
    return held.withColumn("prefix", F.explode(F.sequence(F.shiftright(F.col("first_key") - lo, shift), last))).drop("_f", "_next"), lo, shift


def radix_lookup(ranked: DataFrame, probes: DataFrame, model: DataFrame, per_page: int = 256, prefix_bits: int = 12) -> DataFrame:
    """(probe, rank) through the radix table: a probe's prefix names few segments, the last that begins at or before it counts."""
    table, lo, shift = radix_table(model, prefix_bits)
    table = materialize(table, "radix")
    top = table.agg(F.max("prefix")).first()[0] or 0
    cols = ("first_key", "slope", "first_rank", "last_rank", "max_err")
    asked = probes.filter(F.col("probe") >= lo).withColumn("prefix", F.least(F.shiftright(F.col("probe") - lo, shift), F.lit(top)))
    found = asked.join(table, "prefix").filter("first_key <= probe")
    found = found.groupBy("probe").agg(F.max(F.struct(*cols)).alias("s")).select("probe", "s.*")
    guess = F.col("first_rank") + F.floor(F.col("slope") * (F.col("probe") - F.col("first_key"))).cast("long")
    low = F.least(F.greatest(guess - F.col("max_err") - 1, F.col("first_rank")), F.col("last_rank"))
    high = F.greatest(F.least(guess + F.col("max_err") + 1, F.col("last_rank")), F.col("first_rank"))
    wanted = found.withColumn("low", low).withColumn("high", high).select("probe", F.explode(F.expr(f"sequence(low div {per_page}, high div {per_page})")).alias("page_id"))
    paged = with_pages(ranked, per_page).select(F.col("key").alias("probe"), "page_id", "rank")
    hits = wanted.join(paged, ["probe", "page_id"]).groupBy("probe").agg(F.min("rank").alias("rank"))
    return probes.join(hits, "probe", "left").select("probe", "rank")


def least_square_segments(ranked: DataFrame, size: int, per_page: int, most: float = 0.05, levels: int = 16) -> DataFrame:
    """(first_rank, last_rank, first_key, slope, intercept, page_errors): lines by least squares, merged while they name the right page.

    Blocks of `size` keys have a line each.  Two neighbours merge if one line through both names a
    wrong page for at most a share `most` of their keys; then pairs of merged ones, and so on.  A
    block whose keys are all equal, or whose sums give no slope, gets the chord of its ends.
    """
    rows = materialize(ranked.select("key", "rank").withColumn("b", F.expr(f"rank div {size}")), "to-fit")
    found, left = None, rows
    for level in range(levels + 1):
        seg = left.withColumn("seg", F.shiftright("b", level))
        base = seg.groupBy("seg").agg(F.min("key").alias("k0"), F.min("rank").alias("r0"))
        rel = seg.join(base, "seg").select("seg", "b", "key", "rank", "k0", "r0", (F.col("key") - F.col("k0")).cast("double").alias("x"), (F.col("rank") - F.col("r0")).cast("double").alias("y"))
        rel = materialize(rel, f"relative-{level}")
        chord = F.max("y") / F.greatest(F.max("x"), F.lit(1.0))
        fit = rel.groupBy("seg").agg(F.coalesce(F.regr_slope("y", "x"), chord).alias("slope"), F.coalesce(F.regr_intercept("y", "x"), F.lit(0.0)).alias("intercept"))
        guess = F.expr(f"(r0 + cast(round(intercept + slope * x) as bigint)) div {per_page}") != F.expr(f"rank div {per_page}")
        told = rel.join(fit, "seg").groupBy("seg", "slope", "intercept").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(guess).alias("page_errors"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.min("k0").alias("first_key"), F.countDistinct("b").alias("blocks")
        )
        told = materialize(told.withColumn("good", (F.col("page_errors") <= most * F.col("n")) & (F.col("blocks") == 1 << level) if level else F.lit(True)), f"fitted-{level}")
        # What does not merge keeps the lines of the level below; only pairs of merged ones go on.
        columns = ("first_rank", "last_rank", "first_key", "slope", "intercept", "page_errors")
        if level:
            kept = below.join(told.filter("good").select("seg"), F.shiftright(below["seg"], 1) == told["seg"], "left_anti").select(*columns)
            found = kept if found is None else found.unionByName(kept)
        below = told.filter("good").select("seg", *columns)
        if below.isEmpty():
            break
        left = left.join(below.select(F.col("seg").alias("_s")), F.shiftright("b", level) == F.col("_s"), "left_semi")
    return found if below.isEmpty() else (below.select(*columns) if found is None else found.unionByName(below.select(*columns)))


def tree_levels(n: int, records: int, fill: float, fanout: int) -> list[int]:
    """Pages on each level of a bulk-loaded tree, leaves first: pages are filled to `fill` of their records."""
    pages = [-(-n // max(1, int(records * fill)))]
    while pages[-1] > 1:
        pages.append(-(-pages[-1] // fanout))
    return pages


def index_metrics(ranked: DataFrame, per_page: int, models: dict[str, DataFrame]) -> DataFrame:
    """(name, n, n_bytes): rows and bytes of the data, its zone map and of models of 24 bytes a segment."""
    paged = with_pages(ranked, per_page)
    rows = paged.agg(F.lit("data").alias("name"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 16).alias("n_bytes"))
    z = zones(paged).agg(F.lit("zones").alias("name"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 16).alias("n_bytes"))
    out = rows.unionByName(z)
    for name, m in models.items():
        out = out.unionByName(m.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 24).alias("n_bytes")))
    return out
