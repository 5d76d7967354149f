"""Error-bounded models of the key distribution: linear segments, page-aligned segments, splines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import asof, with_pages, with_rank

SEGMENT = "first_key long, slope double, first_rank long, last_rank long, max_err long"


def cone(keys: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, start: int, knots: bool = False) -> tuple[int, float]:
    """(stop, slope): the longest run from `start` that one line through (key, y) of start keeps in [low, high].

    The slopes that fit shrink to an interval; blocks of doubling size are tested at a time.
    knots: the run also ends before the first key to which the line from start leaves the interval.
    """
    lo, hi, at, block = 0.0, np.inf, start + 1, 64
    while at < len(keys):
        stop = min(len(keys), at + block)
        dx = (keys[at:stop] - keys[start]).astype(float)
        los = np.maximum.accumulate(np.maximum((low[at:stop] - y[start]) / dx, lo))
        his = np.minimum.accumulate(np.minimum((high[at:stop] - y[start]) / dx, hi))
        to = (y[at:stop] - y[start]) / dx
        bad = np.flatnonzero((to < los) | (to > his) if knots else los > his)
        if len(bad):
            k = bad[0]
            if k:
                lo, hi = los[k - 1], his[k - 1]
            return at + int(k), _middle(lo, hi)
        lo, hi, at, block = los[-1], his[-1], stop, min(block * 2, 1 << 16)
    return len(keys), _middle(lo, hi)


def _middle(lo: float, hi: float) -> float:
    return lo if np.isinf(hi) else (lo + hi) / 2


def first_ranks(ranked: DataFrame) -> DataFrame:
    """Distinct keys with their first and last ranks, range-partitioned and sorted: a segment stays in a partition."""
    ends = ranked.groupBy("key").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"))
    return ends.repartitionByRange("key").sortWithinPartitions("key")


def segments(ranked: DataFrame, eps: int, page: int = 0, spline: bool = False, most: int = 1 << 20) -> DataFrame:
    """SEGMENT rows: |first_rank + slope * (key - first_key) - rank| <= max_err, as measured.

    page > 0: any rank on the key's page, widened by eps, is as good (error-bound alignment).
    spline: a segment runs through its last key's rank, so that segments join; one more key is its knot.
    Keys are fitted as they arrive; a segment has about `most` keys at most, which bounds a worker's memory.
    """

    def fit(batches):
        keys, y, last = (np.zeros(0, np.int64) for _ in range(3))
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if batch is not None:
                keys, y, last = (np.concatenate([have, batch[c].to_numpy(np.int64)]) for have, c in ((keys, "key"), (y, "rank"), (last, "last")))
            low, high = (y // page * page - eps, (y // page + 1) * page - 1 + eps) if page else (y - eps, y + eps)
            rows, at = [], 0
            while at < len(keys):
                stop, slope = cone(keys, low, high, y, at, spline)
                if stop == len(keys) and not ended and stop - at < most:
                    break  # the next keys may lie on this line too
                if spline and stop - at > 1:
                    slope = float(y[stop - 1] - y[at]) / float(keys[stop - 1] - keys[at])
                guess = np.floor(y[at] + slope * (keys[at:stop] - keys[at]).astype(float)).astype(np.int64)
                rows.append((keys[at], slope, y[at], last[stop - 1], int(np.abs(guess - y[at:stop]).max())))
                at = stop
            keys, y, last = keys[at:], y[at:], last[at:]
            yield pd.DataFrame(rows, columns=["first_key", "slope", "first_rank", "last_rank", "max_err"])

    return first_ranks(ranked).mapInPandas(fit, SEGMENT)


def model_lookup(table: DataFrame, probes: DataFrame, eps: int, per_page: int = 256, page: int = 0, spline: bool = False) -> DataFrame:
    """(probe, rank): the first rank of the probe, found only on the pages that the model names; null on a miss."""
    ranked = with_rank(table, "key")
    model = segments(ranked, eps, page, spline)
    paged = with_pages(ranked, per_page)
    found = asof(probes, model, "probe", "first_key", ["slope", "first_rank", "last_rank", "max_err"])
    guess = F.col("first_rank") + F.floor(F.col("slope") * (F.col("probe") - F.col("found_key"))).cast("long")
    # Within the segment, and as wide as the error that was measured for it.
    low = F.greatest(guess - F.col("max_err") - 1, F.col("first_rank"))
    high = F.least(guess + F.col("max_err") + 1, F.col("last_rank"))
    found = found.withColumn("low", F.least(low, F.col("last_rank"))).withColumn("high", F.greatest(high, F.col("first_rank")))
    wanted = found.filter("found_key is not null").select("probe", F.explode(F.expr(f"sequence(low div {per_page}, high div {per_page})")).alias("page_id"))
    hits = wanted.join(paged.select(F.col("key").alias("probe"), "page_id", "rank"), ["probe", "page_id"])
    return probes.join(hits.groupBy("probe").agg(F.min("rank").alias("rank")), "probe", "left").select("probe", "rank")


def error_fit(counts: DataFrame) -> DataFrame:
    """a and b of segments(eps) = a * eps ** b, by least squares in logarithms."""
    return counts.select(F.regr_slope(F.log("n"), F.log("eps")).alias("b"), F.exp(F.regr_intercept(F.log("n"), F.log("eps"))).alias("a"))
