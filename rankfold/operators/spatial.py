"""Orthogonal range and nearest-neighbour queries on integer points of two to four dimensions.

Points are stored in the order of their Morton code z, files cut by ranges of z.  A box is
decomposed into at most `most` ranges of z by halving the space; a range is kept whole if it lies in
the box, cut off if it does not meet it.  Their disjunction reaches the Parquet scan as filters on z,
so that files and row groups between the ranges are skipped; the box itself is checked on what is
left, exactly.

Coordinates are integers of 0 to 2^width - 1; others never match a box inside that space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import morton_code
from ..session import materialize
from .ranking import with_rank

AXES = ("x", "y", "z3", "z4")


def z_ordered(points: DataFrame, axes: tuple[str, ...] = ("x", "y"), width: int = 20, files: int | None = None) -> DataFrame:
    """points with their Morton code z, written in its order, so that filters on z prune files and row groups."""
    coded = points.withColumn("z", morton_code([F.col(a) for a in axes], width))
    ranged = coded.repartitionByRange(files, "z") if files else coded.repartitionByRange("z")
    return materialize(ranged.sortWithinPartitions("z"), "z-ordered")


def z_ranges(low: list[int], high: list[int], width: int, most: int = 32) -> list[tuple[int, int]]:
    """At most `most` ranges [a, b] of Morton codes that hold every code of the box low..high, and few others."""
    dims = len(low)
    whole: list[tuple[int, int]] = []
    # (bits decided, code prefix, corner): each step halves a cell along one axis, the highest bit first.
    cells = [(0, 0, (0,) * dims)]
    total = dims * width
    while cells and len(whole) + len(cells) < most:
        cells.sort()  # the largest cell is cut first
        depth, prefix, corner = cells.pop(0)
        if depth == total:
            whole.append((prefix, prefix))
            continue
        axis = (total - 1 - depth) % dims
        for bit in (0, 1):
            level = width - 1 - depth // dims
            c = tuple(v | bit << level if a == axis else v for a, v in enumerate(corner))
            d = depth + 1
            # Bits of an axis that are not decided yet.
            free = [width - (d // dims) - (1 if (total - 1 - a) % dims < d % dims else 0) for a in range(dims)]
            top = [v + (1 << f) - 1 for v, f in zip(c, free, strict=True)]
            if any(v > h or t < lo for v, t, lo, h in zip(c, top, low, high, strict=True)):
                continue
            code = prefix << 1 | bit
            if all(lo <= v and t <= h for v, t, lo, h in zip(c, top, low, high, strict=True)):
                whole.append((code << total - d, (code + 1 << total - d) - 1))
            else:
                cells.append((d, code, c))
    whole += [(p << total - d, (p + 1 << total - d) - 1) for d, p, _ in cells]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(whole):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def box(points: DataFrame, low: list[int], high: list[int], axes: tuple[str, ...] = ("x", "y"), width: int = 20, most: int = 32) -> DataFrame:
    """The points of z_ordered() inside the closed box."""
    near = F.lit(False)
    for a, b in z_ranges(low, high, width, most):
        near = near | F.col("z").between(a, b)
    inside = F.lit(True)
    for a, lo, hi in zip(axes, low, high, strict=True):
        inside = inside & F.col(a).between(lo, hi)
    return points.filter(near & inside)


def nearest(points: DataFrame, queries: DataFrame, k: int, axes: tuple[str, ...] = ("x", "y"), cells: int = 64) -> DataFrame:
    """(query, id, dist, pos): the k nearest points by squared distance, ties by id, of queries (query, *axes).

    The 2k neighbours of a query in the order of z, k on either side, bound its k-th distance.  The
    box of that distance is then laid over a grid of about cells^dims cells between the points'
    extremes, cells join on their numbers, and the k nearest of what meets are exact.
    """
    dims = len(axes)
    ends = points.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).first()
    if ends[0] is None:
        none = points.sparkSession.createDataFrame([], "query long, id long, dist long, pos int")
        return none
    size = [max(1, -(-(ends[dims + i] - ends[i] + 1) // cells)) for i in range(dims)]
    low = [ends[i] for i in range(dims)]
    rows = points.select("id", *axes)
    asked = queries.select("query", *axes)
    # Neighbours by rank in the order of z: a query's place, then k points on either side of it.
    width = max(1, max(max(abs(int(e)) for e in ends), 1).bit_length())
    code = morton_code([F.greatest(F.col(a), F.lit(0)) for a in axes], min(width, 62 // dims))
    placed = materialize(with_rank(rows.withColumn("z", code), "z", "id"), "placed")
    n = placed.count()
    from .ranking import asof

    at = asof(asked.withColumn("p", code), placed.groupBy("z").agg(F.max("rank").alias("rank")), "p", "z", ["rank"]).withColumn("rank", F.coalesce("rank", F.lit(0)))
    first = F.greatest(F.lit(0), F.least(F.col("rank") - k + 1, F.lit(n - 2 * k)))
    near = at.select("query", *[F.col(a).alias(f"q_{a}") for a in axes], F.explode(F.sequence(first, F.least(first + 2 * k - 1, F.lit(n - 1)))).alias("rank"))

    def dist():
        total = None
        for a in axes:
            d = F.col(a) - F.col(f"q_{a}")
            total = d * d if total is None else total + d * d
        return total.cast("long")

    near = near.join(placed.select("rank", *axes), "rank").withColumn("dist", dist())
    top = F.row_number().over(Window.partitionBy("query").orderBy("dist"))
    bound = near.withColumn("pos", top).filter(F.col("pos") <= k).groupBy("query", *[f"q_{a}" for a in axes]).agg(F.max("dist").alias("most"), F.count(F.lit(1)).alias("n"))
    # With fewer than k neighbours all points count.
    bound = bound.withColumn("r", F.when(F.col("n") < k, F.lit(1 << 31)).otherwise(F.ceil(F.sqrt(F.col("most").cast("double"))).cast("long")))
    number = None
    grid = rows
    for i, a in enumerate(axes):
        g = F.floor((F.col(a) - low[i]) / size[i]).cast("int")
        number = g if number is None else number * cells + g
    grid = grid.withColumn("cell", number.cast("long"))
    reach = bound
    cell = None
    for i, a in enumerate(axes):
        lo = F.greatest(F.floor((F.col(f"q_{a}") - F.col("r") - low[i]) / size[i]), F.lit(0)).cast("int")
        hi = F.least(F.floor((F.col(f"q_{a}") + F.col("r") - low[i]) / size[i]), F.lit(cells - 1)).cast("int")
        reach = reach.filter(lo <= hi).withColumn(f"g{i}", F.explode(F.sequence(lo, hi)))
        cell = F.col(f"g{i}") if cell is None else cell * cells + F.col(f"g{i}")
    met = reach.withColumn("cell", cell.cast("long")).join(grid, "cell").withColumn("dist", dist()).filter("n < %d or dist <= most" % k)
    pos = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return met.withColumn("pos", pos).filter(F.col("pos") <= k).select("query", "id", "dist", "pos")
