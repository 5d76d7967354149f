"""Longest linear segments, their shared slopes and compressed tables, and lookups through them.

A segment is a line that stabs [low, high] of every key in it.  Whether one exists is a convex
question in the slope: g(a) = max(low - a x) - min(high - a x) must reach 0 or less.  Tangents from
both ends narrow the slope down, each by one vectorised pass; galloping and bisection find the
longest run.  Fits run inside range partitions, so a segment never crosses one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bits
from ..session import materialize
from .encodings import blocks, guessed, line_fit, line_keys, line_residuals, stored_line
from .models import first_ranks
from .ranking import asof, with_pages, with_rank

HULL = "first_key long, last_key long, slope double, slope_lo double, slope_hi double, intercept long, first_rank long, last_rank long, max_err long"
#: Steps of a search for a slope; running out only ends a segment early.
STEPS = 60


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray, a: float) -> tuple[float, float]:
    """g(a) and its slope there."""
    r, q = low - a * x, high - a * x
    i, j = int(r.argmax()), int(q.argmin())
    return r[i] - q[j], x[j] - x[i]


def stab(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, float] | None:
    """The least and greatest slope of lines that meet every [low, high], or None; x[0] is 0 and x ascends."""
    if len(x) == 1:
        return 0.0, 0.0
    a, b = (low[-1] - high[0]) / x[-1], (high[-1] - low[0]) / x[-1]
    (ga, da), (gb, db) = _gap(x, low, high, a), _gap(x, low, high, b)
    if ga <= 0 and gb <= 0:
        return a, b
    good = a if ga <= 0 else b if gb <= 0 else None
    left, right = (a, ga, da), (b, gb, db)
    for _ in range(STEPS):
        if good is not None:
            break
        (a, ga, da), (b, gb, db) = left, right
        if da >= 0 or db <= 0:
            return None
        s = (gb - ga + da * a - db * b) / (da - db)
        if ga + da * (s - a) > 1e-9 or not a < s < b:
            return None
        g, d = _gap(x, low, high, s)
        if g <= 0:
            good = s
        elif d < 0:
            left = (s, g, d)
        else:
            right = (s, g, d)
    if good is None:
        return None
    # Tangents from outside reach the ends of the interval of slopes that fit.
    ends = []
    for s, g, d in (left, right):
        for _ in range(STEPS):
            if g <= 0 or d == 0:
                break
            t = s - g / d
            if t == s or (t - good) * (s - good) <= 0:
                break
            s = t
            g, d = _gap(x, low, high, s)
        ends.append(s if g <= 0 else good)
    return min(ends), max(ends)


def longest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, tuple[float, float]]:
    """(n, slopes): the first n points have a line, n + 1 have none."""
    n, best, step = 1, (0.0, 0.0), 1
    while n < len(x):
        to = min(len(x), n + step)
        if (found := stab(x[:to], low[:to], high[:to])) is None:
            break
        n, best, step = to, found, step * 2
    else:
        return n, best
    bad = to
    while bad - n > 1:
        mid = (n + bad) // 2
        if (found := stab(x[:mid], low[:mid], high[:mid])) is None:
            bad = mid
        else:
            n, best = mid, found
    return n, best


def bounds_of(y, eps: int, page: int):
    """[low, high] of acceptable ranks; page > 0: any rank on the page, widened by eps."""
    if page:
        return y // page * page - eps, (y // page + 1) * page - 1 + eps
    return y - eps, y + eps


def hull_segments(ranked: DataFrame, eps: int, page: int = 0, most: int = 1 << 20) -> DataFrame:
    """HULL rows: |intercept + floor(slope * (key - first_key)) - rank| <= max_err, as measured.

    Keys are fitted as they arrive; a segment has `most` keys at most, which bounds a worker's memory.
    """

    def row(keys, y, last, n, slopes, low, high):
        slope = sum(slopes) / 2
        x = (keys[:n] - keys[0]).astype(float)
        base = int(np.floor((np.max(low[:n] - slope * x) + np.min(high[:n] - slope * x)) / 2 + 0.5))
        guess = base + np.floor(slope * x).astype(np.int64)
        return keys[0], keys[n - 1], slope, *slopes, base, y[0], last[n - 1], int(np.abs(guess - y[:n]).max())

    def fit(batches):
        keys, y, last = (np.zeros(0, np.int64) for _ in range(3))
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if batch is not None:
                keys, y, last = (np.concatenate([have, batch[c].to_numpy(np.int64)]) for have, c in ((keys, "key"), (y, "rank"), (last, "last")))
            rows = []
            while len(keys):
                part = slice(0, most)
                low, high = (v.astype(float) for v in bounds_of(y[part], eps, page))
                n, slopes = longest((keys[part] - keys[0]).astype(float), low, high)
                if n == len(keys) and not ended and n < most:
                    break
                rows.append(row(keys, y, last, n, slopes, low, high))
                keys, y, last = keys[n:], y[n:], last[n:]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HULL.split(", ")])

    return first_ranks(ranked).mapInPandas(fit, HULL)


def merge_slopes(model: DataFrame) -> DataFrame:
    """model with slope_id, and one slope for every group of segments whose slope intervals meet.

    Intervals sorted by their upper ends are stabbed greedily, which takes the fewest slopes; it is
    done inside range partitions, at the price of at most one more slope for each.
    """

    def stabbed(batches):
        at = None
        for x in batches:
            shared = []
            for lo, hi in zip(x["slope_lo"], x["slope_hi"], strict=True):
                if at is None or lo > at:
                    at = hi
                shared.append(at)
            yield x.assign(slope=shared)

    out = model.repartitionByRange("slope_hi").sortWithinPartitions("slope_hi").mapInPandas(stabbed, model.schema)
    return out


def refit(ranked: DataFrame, model: DataFrame, eps: int, page: int = 0) -> DataFrame:
    """model with the middle intercept of each segment's slope, and the error that it makes."""
    ends = ranked.groupBy("key").agg(F.min("rank").alias("rank"))
    held = asof(ends, model, "key", "first_key", ["first_key", "slope"])
    x = F.col("slope") * (F.col("key") - F.col("first_key"))
    low, high = (F.expr(f"rank div {page} * {page} - {eps}"), F.expr(f"(rank div {page} + 1) * {page} - 1 + {eps}")) if page else (F.col("rank") - eps, F.col("rank") + eps)
    middle = held.groupBy("first_key").agg(F.floor((F.max(low - x) + F.min(high - x)) / 2 + 0.5).cast("long").alias("intercept"), F.max(F.col("rank") - F.floor(x)).alias("above"), F.min(F.col("rank") - F.floor(x)).alias("below"))
    middle = middle.withColumn("max_err", F.greatest(F.abs(F.col("above") - F.col("intercept")), F.abs(F.col("intercept") - F.col("below"))).cast("long"))
    return model.drop("intercept", "max_err").join(middle.drop("above", "below"), "first_key")


def elias_fano_bits(n: Column, universe: Column) -> Column:
    """Size in bits of n ascending numbers below `universe`: low bits plain, high bits in unary."""
    low = F.greatest(F.floor(F.log2(F.greatest(universe, F.lit(1)) / F.greatest(n, F.lit(1)))), F.lit(0))
    return (n * (2 + low)).cast("long")


def compress(model: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """The stored form (lines, rows): blocks of `block` segments in the order of keys.

    lines hold a line of first keys, the first rank and the largest error of each block; rows hold a
    residual of the key, the number of the slope in a table of distinct ones, the ranks that the
    segment covers, and the intercept as a step of the running maximum, which ascends, and a correction.
    """
    numbers = with_rank(materialize(model.select("slope").distinct(), "slopes"), "slope", name="slope_id")
    b = blocks(model.select(F.col("first_key").alias("key"), F.col("slope").alias("of_slope"), F.col("intercept").alias("of_rank"), "first_rank", "last_rank", "max_err"), block)
    b = materialize(b, "model-blocks")
    ends = b.groupBy("block_id").agg(F.min("first_rank").alias("base_rank"), F.max("max_err").alias("max_err"))
    lines = materialize(stored_line(line_fit(b)).join(ends, "block_id"), "model-lines")
    coded = line_residuals(b, lines).join(numbers.select("slope_id", F.col("slope").alias("of_slope")), "of_slope")
    w = Window.partitionBy("block_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    coded = coded.withColumn("climb", F.max("of_rank").over(w))
    before = F.coalesce(F.lag("climb").over(Window.partitionBy("block_id").orderBy("idx")), F.lit(0))
    return lines, coded.select("block_id", "idx", "residual", "slope_id", (F.col("climb") - before).alias("step"), (F.col("climb") - F.col("of_rank")).alias("correction"), (F.col("last_rank") - F.col("first_rank") + 1).alias("covers"))


def decompress(lines: DataFrame, rows: DataFrame, slopes: DataFrame) -> DataFrame:
    """The model again from its stored form and `slopes` (slope_id, slope); errors are those of the blocks."""
    w = Window.partitionBy("block_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = line_keys(rows, lines, "first_key").join(lines.select("block_id", "base_rank", "max_err"), "block_id").join(slopes, "slope_id")
    last = F.col("base_rank") + F.sum("covers").over(w) - 1
    out = out.withColumn("last_rank", last).withColumn("intercept", F.sum("step").over(w) - F.col("correction"))
    return out.select("first_key", "slope", "intercept", (F.col("last_rank") - F.col("covers") + 1).alias("first_rank"), "last_rank", "max_err")


def slope_table(model: DataFrame) -> DataFrame:
    return with_rank(materialize(model.select("slope").distinct(), "slopes"), "slope", name="slope_id").select("slope_id", "slope")


def model_bits(coded: DataFrame) -> DataFrame:
    """block_id, n, and the bits that its keys, intercepts and slope numbers take."""
    b = coded.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("residual")).alias("r"), F.sum("step").alias("u"), F.count_if(F.col("correction") > 0).alias("fixed"), F.max("slope_id").alias("s"))
    return b.select("block_id", "n", (F.col("n") * (bits(F.col("r")) + 1)).alias("key_bits"), (elias_fano_bits(F.col("n"), F.col("u")) + F.col("fixed") * 64).alias("intercept_bits"), (F.col("n") * bits(F.col("s"))).alias("slope_bits"))


def find_ranks(ranked: DataFrame, probes: DataFrame, model: DataFrame, per_page: int = 256, buckets: int = 0) -> DataFrame:
    """(probe, rank): the first rank of each probe, on the pages that its segment names; null on a miss.

    buckets > 0: segments are found through a table of equal key ranges, else by the as-of search.
    """
    cols = ["slope", "intercept", "first_rank", "last_rank", "max_err"]
    if buckets:
        lo, hi = model.agg(F.min("first_key"), F.max("last_key")).first()
        width = max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
        base = F.lit(lo or 0)
        cell = F.explode(F.sequence(F.expr(f"(first_key - {lo or 0}L) div {width}L"), F.expr(f"(last_key - {lo or 0}L) div {width}L"))).alias("cell")
        tops = model.select("first_key", "last_key", *cols, cell)
        asked = probes.filter(F.col("probe").between(base, F.lit(hi or 0))).withColumn("cell", F.expr(f"(probe - {lo or 0}L) div {width}L"))
        found = asked.join(tops, "cell").filter(F.col("probe").between(F.col("first_key"), F.col("last_key"))).withColumn("found_key", F.col("first_key"))
    else:
        found = asof(probes, model, "probe", "first_key", cols).filter("found_key is not null")
    guess = F.col("intercept") + F.floor(F.col("slope") * (F.col("probe") - F.col("found_key"))).cast("long")
    low = F.least(F.greatest(guess - F.col("max_err") - 1, F.col("first_rank")), F.col("last_rank"))
    high = F.greatest(F.least(guess + F.col("max_err") + 1, F.col("last_rank")), F.col("first_rank"))
    found = found.withColumn("low", low).withColumn("high", high)
    wanted = found.select("probe", F.explode(F.expr(f"sequence(low div {per_page}, high div {per_page})")).alias("page_id"))
    paged = with_pages(ranked, per_page)
    hits = wanted.join(paged.select(F.col("key").alias("probe"), "page_id", "rank"), ["probe", "page_id"])
    return probes.join(hits.groupBy("probe").agg(F.min("rank").alias("rank")), "probe", "left").select("probe", "rank")


def separators(ranked: DataFrame, per_page: int, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """The stored form (lines, rows: block_id, idx, residual) of a separator for each page: any value above the page before and up to its first key.

    A separator comes from a line for each block of pages; the residual is 0 where the line's value is
    acceptable, else the distance to the nearer bound.  Of keys that run over a page's end, the
    separator names the later page.
    """
    z = with_pages(ranked, per_page).groupBy("page_id").agg(F.min("key").alias("key"), F.max("key").alias("hi"))
    z = materialize(z, "zones")
    before = z.select((F.col("page_id") + 1).alias("page_id"), F.col("hi").alias("before"))
    z = z.join(before, "page_id", "left").withColumn("block_id", F.expr(f"page_id div {block}")).withColumn("idx", F.expr(f"page_id % {block}"))
    lines = materialize(stored_line(line_fit(z)), "separator-lines")
    coded = guessed(z, lines)
    low = F.least(F.coalesce(F.col("before") + 1, F.col("key")), F.col("key"))
    residual = F.when(F.col("guess") < low, low - F.col("guess")).when(F.col("guess") > F.col("key"), F.col("key") - F.col("guess")).otherwise(F.lit(0))
    return lines, materialize(coded.select("block_id", "idx", residual.cast("long").alias("residual")), "separators")


def slack_separators(ranked: DataFrame, per_page: int, fix: int, slide: int, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """The stored form (lines, rows) of one separator for each group of fix + slide pages, free to lie in the `slide` pages before it.

    A probe at or above a group's separator is on the group's pages or on those it may slide over.
    """
    group = fix + slide
    z = with_pages(ranked, per_page).groupBy("page_id").agg(F.min("key").alias("key"))
    z = materialize(z, "zones")
    starts = z.filter(F.col("page_id") % group == 0).select(F.expr(f"page_id div {group}").alias("g"), "key")
    early = z.select(F.expr(f"(page_id + {slide}) div {group}").alias("g"), F.col("key").alias("early"), (F.col("page_id") + slide).alias("p")).filter(F.col("p") % group == 0).drop("p")
    z = starts.join(early, "g", "left").withColumn("block_id", F.expr(f"g div {block}")).withColumn("idx", F.expr(f"g % {block}"))
    lines = materialize(stored_line(line_fit(z)), "slack-lines")
    coded = guessed(z, lines)
    low = F.coalesce("early", "key")
    residual = F.when(F.col("guess") < low, low - F.col("guess")).when(F.col("guess") > F.col("key"), F.col("key") - F.col("guess")).otherwise(F.lit(0))
    return lines, materialize(coded.select("block_id", "idx", residual.cast("long").alias("residual")), "slack-rows")


def slack_lookup(ranked: DataFrame, probes: DataFrame, lines: DataFrame, rows: DataFrame, per_page: int, fix: int, slide: int, block: int = 64) -> DataFrame:
    """(probe, rank) through slack_separators(): a probe reads its group and the `slide` pages before it."""
    seps = page_values(lines, rows, "separator", block).withColumnRenamed("page_id", "g")
    at = asof(probes, seps, "probe", "separator", ["g"]).filter("g is not null")
    first, last = F.greatest(F.col("g") * (fix + slide) - slide, F.lit(0)), (F.col("g") + 1) * (fix + slide) - 1
    wanted = at.select("probe", F.explode(F.sequence(first, last)).alias("page_id"))
    paged = with_pages(ranked, per_page).select(F.col("key").alias("probe"), "page_id", "rank")
    hits = wanted.join(paged, ["probe", "page_id"]).groupBy("probe").agg(F.min("rank").alias("rank"))
    return probes.join(hits, "probe", "left").select("probe", "rank")


def page_values(lines: DataFrame, rows: DataFrame, name: str, block: int = 64) -> DataFrame:
    """(page_id, name): the values of separators() or coded_zones(), from their stored form alone."""
    return line_keys(rows, lines, name).select((F.col("block_id") * block + F.col("idx")).alias("page_id"), name)


def page_of(probes: DataFrame, seps: DataFrame) -> DataFrame:
    """(probe, page_id): the one page that can hold the probe, null below the first separator."""
    return asof(probes, seps, "probe", "separator", ["page_id"]).select("probe", "page_id")


def coded_zones(ranked: DataFrame, per_page: int, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """The stored form (lines, rows) of the first keys of pages: a line for each block of pages, and residuals."""
    z = materialize(with_pages(ranked, per_page).groupBy("page_id").agg(F.min("key").alias("key")), "zones")
    z = z.withColumn("block_id", F.expr(f"page_id div {block}")).withColumn("idx", F.expr(f"page_id % {block}"))
    lines = materialize(stored_line(line_fit(z)), "zone-lines")
    return lines, materialize(line_residuals(z, lines).select("block_id", "idx", "residual"), "coded-zones")


def in_page(ranked: DataFrame, asked: DataFrame, per_page: int) -> DataFrame:
    """(probe, rank) of asked (probe, page_id): the probe's first rank on that page, or null."""
    paged = with_pages(ranked, per_page).select(F.col("key").alias("probe"), "page_id", "rank")
    return asked.join(paged, ["probe", "page_id"], "left").groupBy("probe").agg(F.min("rank").alias("rank"))
