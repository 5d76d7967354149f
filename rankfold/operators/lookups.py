"""Point, range and scan lookups over ranked key tables, and the pages that fetch strategies read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import asof, with_pages, with_rank, zones


def zone_lookup(table: DataFrame, probes: DataFrame, per_page: int = 256) -> DataFrame:
    """(probe, page_id, value): the zone whose [lo, hi] holds the probe and the value found in it; nulls for a miss."""
    paged = materialize(with_pages(with_rank(table, "key"), per_page), "paged")
    zone = asof(probes.select("probe").distinct(), zones(paged), "probe", "lo", ["page_id", "hi"])
    zone = materialize(zone.select("probe", F.when(F.col("probe") <= F.col("hi"), F.col("page_id")).alias("page_id")), "zoned")
    # Of duplicates that reach over pages the last page is found here; bounds() gives all of them.
    # An inner join first: the probes are the side that may be sent to all executors, not the table.
    hits = paged.select(F.col("key").alias("probe"), "page_id", "value").join(zone.filter("page_id is not null"), ["probe", "page_id"])
    return zone.join(hits, ["probe", "page_id"], "left").select("probe", "page_id", "value")


def point_lookup(table: DataFrame, probes: DataFrame, most: int = 100) -> DataFrame:
    """(probe, n, total): how many of at most `most` duplicates qualify, and the sum of their keys; null on a miss."""
    # Only keys that are asked for are grouped.
    asked = table.join(probes.select(F.col("probe").alias("key")).distinct(), "key", "left_semi")
    counts = asked.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    out = probes.join(counts, probes["probe"] == counts["key"], "left")
    return out.select("probe", "n", (F.col("n") * F.col("key")).cast("decimal(38,0)").alias("total"))


def bounds(table: DataFrame, probes: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(probe, lower, upper): numbers of keys below, and at most, the probe; `ranked` is the table where its ranks are known."""
    ends = (ranked if ranked is not None else with_rank(table, "key")).groupBy("key").agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("stop"))
    out = asof(probes, ends, "probe", "key", ["first", "stop"])
    same = F.col("found_key") == F.col("probe")
    return out.select("probe", F.when(same, F.col("first")).otherwise(F.coalesce("stop", F.lit(0))).alias("lower"), F.coalesce("stop", F.lit(0)).alias("upper"))


def scan(table: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(start, found, total): the first n records from the least key >= start, by ranks and an equi-join."""
    ranked = materialize(with_rank(table, "key", "value"), "ranked")
    first = bounds(table, starts.select(F.col("start").alias("probe")), ranked).select(F.col("probe").alias("start"), "lower")
    wanted = first.select("start", F.explode(F.sequence(F.col("lower"), F.col("lower") + (n - 1))).alias("rank"))
    got = wanted.join(ranked.select("rank", "value"), "rank").groupBy("start").agg(F.count(F.lit(1)).alias("found"), F.sum("value").alias("total"))
    return starts.join(got, "start", "left").select("start", F.coalesce("found", F.lit(0)).alias("found"), "total")


def fetched_pages(strategy: str, hit: str = "rank", low: str = "low", high: str = "high", per_page: int = 256) -> Column:
    """Pages read to find item `hit` when a model says [low, high]."""
    p0, p1, p = f"({low} div {per_page})", f"({high} div {per_page})", f"({hit} div {per_page})"
    mid = f"(({p0} + {p1}) div 2)"
    return F.expr({
        "start_worst": f"{p1} - {p0} + 1",
        "start_1by1": f"{p} - {p0} + 1",
        "mid_worst": f"CASE WHEN {p} = {mid} THEN 1 WHEN {p} < {mid} THEN 1 + {mid} - {p0} ELSE 1 + {p1} - {mid} END",
        "mid_1by1": f"abs({p} - {mid}) + 1",
        "half": f"CASE WHEN {p} <= {mid} THEN {mid} - {p0} + 1 ELSE {p1} - {p0} + 1 END",
    }[strategy]).cast("long")
