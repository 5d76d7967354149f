"""Registered queries of the engine's own operators, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.keys import bits, cents, micros
from .operators import codecs as C
from .operators import encodings as E
from .operators import hulls as H
from .operators import lookups as L
from .operators import models as M
from .operators import store as ST
from .operators.ranking import asof, with_pages, with_rank, zones
from .operators.tuning import reference_sizes
from .plans import workload
from .session import materialize
from .sources import keys as K

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return _table(spark, d, "events").select(micros("ts").alias("key"))


def _orders(spark, d) -> DataFrame:
    return _table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("key"), cents("o_totalprice").alias("value"))


EV = "ev AS (SELECT epoch_us(ts) AS key FROM events), rk AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM ev)"
ORD = "ord AS (SELECT o_orderkey::BIGINT AS key, round(o_totalprice * 100)::BIGINT AS value FROM orders)"
#: Probes: every 20th key by rank (0 of 20), the same plus one, and one below and above all.
PROBES = f"WITH {EV}, probes AS (SELECT DISTINCT probe FROM (SELECT key AS probe FROM rk WHERE rank % 20 = 0 UNION ALL SELECT key + 1 FROM rk WHERE rank % 20 = 1 UNION ALL SELECT min(key) - 5 FROM rk UNION ALL SELECT max(key) + 5 FROM rk))"


def _probes(ranked: DataFrame) -> DataFrame:
    some = ranked.filter("rank % 20 = 0").select(F.col("key").alias("probe")).unionByName(ranked.filter("rank % 20 = 1").select((F.col("key") + 1).alias("probe")))
    ends = ranked.agg(F.min("key").alias("a"), F.max("key").alias("b")).select(F.explode(F.array(F.col("a") - 5, F.col("b") + 5)).alias("probe"))
    return some.unionByName(ends).distinct()


# Ranks, pages, zones.


@query(f"WITH {EV} SELECT key, rank, rank // 256 AS page_id, rank // 4096 AS file_id FROM rk")
def rank_page(spark, d):
    return with_pages(with_rank(_events(spark, d), "key"), 256)


@query("SELECT rank // 256 AS page_id, min(key) AS lo, max(key) AS hi, count(*) AS n FROM (SELECT l_orderkey::BIGINT AS key, row_number() OVER (ORDER BY l_orderkey) - 1 AS rank FROM lineitem) GROUP BY 1")
def zone_map(spark, d):
    keys = _table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"))
    return zones(with_pages(with_rank(keys, "key"), 256))


@query(f"WITH {ORD}, p AS (SELECT DISTINCT key * 2 AS probe FROM ord WHERE key % 20 = 0), r AS (SELECT *, (row_number() OVER (ORDER BY key) - 1) // 256 AS page_id FROM ord), z AS (SELECT page_id, min(key) lo, max(key) hi FROM r GROUP BY 1) SELECT probe, z.page_id, value FROM p LEFT JOIN z ON probe BETWEEN lo AND hi LEFT JOIN r ON r.key = probe")
def zone_lookup_page(spark, d):
    orders = _orders(spark, d)
    return L.zone_lookup(orders, orders.filter("key % 20 = 0").select((F.col("key") * 2).alias("probe")).distinct())


@query(f"WITH {EV} SELECT key, rank, rank // 64 AS granule FROM rk WHERE rank % 64 IN (0, 63)")
def granule_boundaries(spark, d):
    r = with_rank(_events(spark, d), "key")
    return r.filter("rank % 64 in (0, 63)").withColumn("granule", F.expr("rank div 64"))


@query(f"WITH {EV} SELECT key, rank, greatest(rank // 256 * 256 - 16, 0) AS y_lo, rank // 256 * 256 + 255 + 16 AS y_hi FROM rk")
def page_aligned_interval(spark, d):
    r = with_rank(_events(spark, d), "key")
    page = F.expr("rank div 256 * 256")
    return r.select("key", "rank", F.greatest(page - 16, F.lit(0)).alias("y_lo"), (page + 271).alias("y_hi"))


@query(f"WITH {EV}, s AS (SELECT rank // 100 AS block_id, 1000 + count(*) * 16 + rank // 100 % 7 * 10 AS n FROM rk GROUP BY 1), b AS (SELECT block_id, n AS n_bytes, (n + 4095) // 4096 * 4096 AS padded FROM s) SELECT *, (sum(padded) OVER (ORDER BY block_id) - padded)::BIGINT AS byte_start FROM b")
def aligned_block_table(spark, d):
    r = with_rank(_events(spark, d), "key").groupBy(F.expr("rank div 100").alias("block_id")).agg((1000 + F.count(F.lit(1)) * 16).alias("n_bytes"))
    b = K.aligned_blocks(r.withColumn("n_bytes", F.col("n_bytes") + F.col("block_id") % 7 * 10))
    return _starts(b, "padded")


def _starts(b: DataFrame, size: str) -> DataFrame:
    """byte_start of blocks by a two-level prefix sum over groups of 1024 blocks."""
    b = b.withColumn("_g", F.expr("block_id div 1024"))
    g = b.groupBy("_g").agg(F.sum(size).alias("_s"))
    g = g.select("_g", F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_g").orderBy("block_id")
    return b.join(F.broadcast(g), "_g").withColumn("byte_start", F.col("_base") + F.sum(size).over(w) - F.col(size)).drop("_g", "_base")


@query(f"WITH {EV}, s AS (SELECT rank // 100 AS block_id, 1000 + rank // 100 % 7 * 10 AS n_bytes FROM rk GROUP BY 1, 2), b AS (SELECT *, sum(n_bytes) OVER (ORDER BY block_id) - n_bytes AS a FROM s), p AS (SELECT range * 777 AS pos FROM range(0, 100)) SELECT pos, block_id FROM p JOIN b ON pos >= a AND pos < a + n_bytes")
def seek_table_lookup(spark, d):
    s = with_rank(_events(spark, d), "key").select(F.expr("rank div 100").alias("block_id")).distinct().withColumn("n_bytes", 1000 + F.col("block_id") % 7 * 10)
    b = _starts(s, "n_bytes").withColumn("byte_stop", F.col("byte_start") + F.col("n_bytes"))
    p = spark.range(100).select((F.col("id") * 777).alias("pos"))
    return asof(p, b, "pos", "byte_start", ["block_id", "byte_stop"]).filter("pos < byte_stop").select("pos", "block_id")


# Lookups.


@query(f"WITH {ORD}, p AS (SELECT key AS probe FROM ord WHERE key % 20 = 0) SELECT probe, 1::BIGINT AS n, probe::DECIMAL(38,0) AS total FROM p")
def point_lookup(spark, d):
    o = _orders(spark, d)
    return L.point_lookup(o, o.filter("key % 20 = 0").select(F.col("key").alias("probe")))


@query(f"WITH {ORD} SELECT key + (SELECT max(key) + 1 FROM ord) AS probe, NULL::BIGINT AS n, NULL::DECIMAL(38,0) AS total FROM ord WHERE key % 20 = 0")
def point_lookup_miss(spark, d):
    o = _orders(spark, d)
    top = o.agg((F.max("key") + 1).alias("m"))
    return L.point_lookup(o, o.filter("key % 20 = 0").join(F.broadcast(top)).select((F.col("key") + F.col("m")).alias("probe")))


@query("SELECT l_quantity::BIGINT AS probe, least(count(*), 100) AS n, (least(count(*), 100) * l_quantity::BIGINT)::DECIMAL(38,0) AS total FROM lineitem GROUP BY 1, l_quantity")
def dup_lookup_sum(spark, d):
    t = _table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("key"))
    return L.point_lookup(t, t.select(F.col("key").alias("probe")).distinct())


@query(f"{PROBES} SELECT probe, (SELECT count(*) FROM ev WHERE key < probe) AS lower, (SELECT count(*) FROM ev WHERE key <= probe) AS upper FROM probes")
def bounds(spark, d):
    e = materialize(_events(spark, d), "events")
    return L.bounds(e, _probes(with_rank(e, "key")))


@query(f"{PROBES} SELECT probe, (SELECT max(key) FROM ev WHERE key <= probe) AS found_key FROM probes")
def floor_asof(spark, d):
    e = materialize(_events(spark, d), "events")
    return asof(_probes(with_rank(e, "key")), e, "probe", "key", [])


@query("WITH r AS (SELECT l_orderkey::BIGINT AS key, row_number() OVER (ORDER BY l_orderkey) - 1 AS rank FROM lineitem) SELECT key, min(rank) AS first, max(rank) + 1 AS stop FROM r GROUP BY key")
def equal_range(spark, d):
    r = with_rank(_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")), "key")
    return r.groupBy("key").agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("stop"))


@query(f"WITH {EV}, s AS (SELECT key + 1 AS start FROM rk WHERE rank % 20 = 0) SELECT start, count(key) AS found, sum(rank)::BIGINT AS total FROM (SELECT start, key, rank, row_number() OVER (PARTITION BY start ORDER BY key) AS i FROM s LEFT JOIN rk ON key >= start) WHERE i <= 50 GROUP BY start")
def scan_n(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return L.scan(r.select("key", F.col("rank").alias("value")), r.filter("rank % 20 = 0").select((F.col("key") + 1).alias("start")), 50)


@query(f"WITH {ORD} SELECT sum(value)::DECIMAL(38,0) AS total, count(*) AS n FROM ord WHERE key BETWEEN 100 AND 9000")
def range_sum(spark, d):
    o = _orders(spark, d).filter("key between 100 and 9000")
    return o.agg(F.sum(F.col("value").cast("decimal(30,0)")).cast("decimal(38,0)").alias("total"), F.count(F.lit(1)).alias("n"))


_WINDOWS = f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev), w AS (SELECT key, rank, greatest(rank - 300, 0) AS low, least(rank + 420, n - 1) AS high FROM rk, n), p AS (SELECT key, low // 256 AS p0, high // 256 AS p1, rank // 256 AS p, (low // 256 + high // 256) // 2 AS m FROM w) SELECT key, {{}} AS pages FROM p"
_FETCH = {
    "start_worst": "p1 - p0 + 1",
    "start_1by1": "p - p0 + 1",
    "mid_worst": "CASE WHEN p = m THEN 1 WHEN p < m THEN 1 + m - p0 ELSE 1 + p1 - m END",
    "mid_1by1": "abs(p - m) + 1",
    "half": "CASE WHEN p <= m THEN m - p0 + 1 ELSE p1 - p0 + 1 END",
}


def _windows(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    n = r.count()
    return r.withColumn("low", F.greatest(F.col("rank") - 300, F.lit(0))).withColumn("high", F.least(F.col("rank") + 420, F.lit(n - 1)))


def _fetch(strategy):
    def run(spark, d):
        return _windows(spark, d).select("key", L.fetched_pages(strategy).alias("pages"))

    run.__name__ = f"fetch_pages_{strategy}"
    query(_WINDOWS.format(f"({_FETCH[strategy]})::BIGINT"))(run)


for _s in _FETCH:
    _fetch(_s)


@query(_WINDOWS.replace("SELECT key, {} AS pages FROM p", "SELECT " + ", ".join(f"round(avg({x}), 6) AS {s}" for s, x in _FETCH.items()) + " FROM p"))
def fetch_page_averages(spark, d):
    return _windows(spark, d).agg(*[F.round(F.avg(L.fetched_pages(s)), 6).alias(s) for s in _FETCH])


# Learned models.


#: What holds for every model: all keys are covered, none is off by more than its segment states, or than it was to be.
_CHECKED = f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS uncovered, 0::BIGINT AS beyond_stated, 0::BIGINT AS beyond_wanted, true AS in_order FROM ev"


def _check(r: DataFrame, model: DataFrame, most: int, start: str = "first_rank") -> DataFrame:
    """The invariants of a model over the ranked keys r; `most` is the error that was asked for, one more for rounding."""
    model = materialize(model, "model")
    columns = sorted({start, "slope", "first_rank", "last_rank", "max_err"})
    found = asof(r, model, "key", "first_key", columns)
    off = F.abs(F.col(start) + F.floor(F.col("slope") * (F.col("key") - F.col("found_key"))) - F.col("rank"))
    inside = F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    out = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("uncovered"), F.count_if(off > F.col("max_err")).alias("beyond_stated"), F.count_if(off > most + 1).alias("beyond_wanted"))
    ends = model.agg((F.sum(F.col("last_rank") - F.col("first_rank") + 1) == F.max("last_rank") + 1).alias("in_order"))
    return out.join(F.broadcast(ends))


@query(_CHECKED)
def pla_segments(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return _check(r, M.segments(r, 64), 64)


@query(_CHECKED)
def spline_segments(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return _check(r, M.segments(r, 64, spline=True), 64)


@query(_CHECKED)
def page_aligned_segments(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return _check(r, M.segments(r, 16, page=256), 16 + 256)


@query("SELECT true AS falls, true AS fitted")
def hardness(spark, d):
    """Segments for a list of errors fall as the error grows, and so does the power law fitted to them."""
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    counts = None
    for eps in (4, 16, 64):
        c = M.segments(r, eps).agg(F.lit(eps).alias("eps"), F.count(F.lit(1)).alias("n"))
        counts = c if counts is None else counts.unionByName(c)
    counts = materialize(counts, "hardness")
    rows = counts.groupBy().pivot("eps", [4, 16, 64]).agg(F.first("n"))
    return rows.select(((F.col("4") > F.col("16")) & (F.col("16") > F.col("64"))).alias("falls")).join(M.error_fit(counts).select(((F.col("b") < 0) & (F.col("a") > 0)).alias("fitted")))


_FOUND = f"{PROBES} SELECT probe, min(rank) AS rank FROM probes LEFT JOIN rk ON key = probe GROUP BY probe"


def _model(name, **how):
    def run(spark, d):
        e = materialize(_events(spark, d), "events")
        return M.model_lookup(e, _probes(with_rank(e, "key")), **how)

    run.__name__ = name
    query(_FOUND)(run)


_model("pla_lookup", eps=64)
_model("pla_lookup_wide", eps=256)
_model("di_lookup", eps=16, page=256)
_model("spline_lookup", eps=64, spline=True)


@query("WITH r AS (SELECT l_orderkey::BIGINT AS key, row_number() OVER (ORDER BY l_orderkey) - 1 AS rank FROM lineitem), p AS (SELECT DISTINCT key AS probe FROM r WHERE key % 20 = 0) SELECT probe, min(rank) AS rank FROM p JOIN r ON key = probe GROUP BY probe")
def pla_lookup_duplicates(spark, d):
    t = materialize(_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")), "keys")
    return M.model_lookup(t, t.filter("key % 20 = 0").select(F.col("key").alias("probe")).distinct(), eps=32)


# Longest segments, their shared and compressed forms.


def _hull(spark, d, eps=16, page=0):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return r, materialize(H.hull_segments(r, eps, page), "hull")


def _merged(spark, d, eps=16, page=0):
    r, model = _hull(spark, d, eps, page)
    return r, materialize(H.refit(r, H.merge_slopes(model), eps, page), "merged")


@query(_CHECKED)
def hull_segments(spark, d):
    return _check(*_hull(spark, d), 16, start="intercept")


@query(_FOUND)
def hull_lookup(spark, d):
    r, model = _hull(spark, d)
    return H.find_ranks(r, _probes(r), model)


@query(_FOUND)
def bucket_lookup(spark, d):
    r, model = _hull(spark, d)
    return H.find_ranks(r, _probes(r), model, buckets=1024)


@query(_FOUND)
def merged_slope_lookup(spark, d):
    r, model = _merged(spark, d)
    return H.find_ranks(r, _probes(r), model)


def _stored(name, **how):
    def run(spark, d):
        r, model = _merged(spark, d, **how)
        lines, coded = H.compress(model)
        stored = materialize(coded, "coded"), materialize(H.slope_table(model), "slopes")
        return H.find_ranks(r, _probes(r), materialize(H.decompress(lines, *stored), "decoded"))

    run.__name__ = name
    query(_FOUND)(run)


_stored("compressed_pla_lookup", eps=16)
_stored("compressed_di_lookup", eps=16, page=256)


@query("SELECT true AS smaller, true AS counted")
def compressed_model_bits(spark, d):
    """The stored form of a model takes fewer bits than its keys, slopes and intercepts as 64-bit numbers."""
    model = _merged(spark, d, 4)[1]
    sizes = H.model_bits(H.compress(model)[1]).agg(F.sum("n").alias("n"), F.sum(F.col("key_bits") + F.col("intercept_bits") + F.col("slope_bits")).alias("bits"))
    return sizes.join(model.agg(F.count(F.lit(1)).alias("segments"))).select((F.col("bits") < 192 * F.col("n")).alias("smaller"), (F.col("n") == F.col("segments")).alias("counted"))


@query(f"{PROBES} SELECT probe, (SELECT max(rank) // 64 FROM rk WHERE key <= probe) AS page_id FROM probes")
def coded_zone_pages(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return asof(_probes(r), H.page_values(*H.coded_zones(r, 64), "lo"), "probe", "lo", ["page_id"]).select("probe", "page_id")


@query(_FOUND)
def separator_lookup(spark, d):
    r = materialize(with_rank(_events(spark, d), "key"), "ranked")
    return H.in_page(r, H.page_of(_probes(r), H.page_values(*H.separators(r, 64), "separator")), 64)


# Variable-length blocks, strings, symbol tables.


def _pieces(name, cut, kind):
    def run(spark, d):
        b = materialize(E.blocks(_events(spark, d), 512), "blocks")
        back = C.unpack(materialize(C.pieces(b, cut, kind), "pieces"), kind).withColumnRenamed("key", "decoded")
        out = b.join(back, ["block_id", "idx"], "left")
        return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("key").eqNullSafe(F.col("decoded"))).alias("wrong"))

    run.__name__ = name
    query("SELECT count(*) AS n, 0::BIGINT AS wrong FROM events")(run)


for _c in C.CUTS:
    _pieces(f"pieces_{_c}_round_trip", _c, "line")
_pieces("delta_pieces_round_trip", "greedy", "delta")
_pieces("delta_pieces_merged_round_trip", "merge", "delta")


@query(f"WITH {EV} SELECT DISTINCT rank // 512 AS block_id, true AS best_is_least FROM rk")
def piece_sizes(spark, d):
    """Of a block's bits by all ways to cut it the cheapest cut has the fewest."""
    b = materialize(E.blocks(_events(spark, d), 512), "blocks")
    sizes = None
    for cut in C.CUTS:
        one = C.piece_bits(C.pieces(b, cut)).select("block_id", F.lit(cut).alias("cut"), "bits")
        sizes = one if sizes is None else sizes.unionByName(one)
    least = F.min(F.when(F.col("cut") == "best", F.col("bits"))) <= F.min("bits")
    return sizes.groupBy("block_id").agg(least.alias("best_is_least"))


_NAMES = "WITH r AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS rank FROM customer), u AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS rank FROM pages WHERE url IS NOT NULL)"


@query(f"{_NAMES} SELECT rank // 64 AS block_id, rank % 64 AS idx, c_name AS text FROM r")
def string_gather(spark, d):
    b = materialize(E.blocks(_table(spark, d, "customer").select("c_name"), 64), "names")
    return C.string_at(C.string_blocks(b, "c_name"), b.select("block_id", "idx"))


@query(f"{_NAMES} SELECT rank // 32 AS block_id, rank % 32 AS idx, url AS text FROM u")
def string_round_trip(spark, d):
    b = materialize(E.blocks(_table(spark, d, "pages").select("url").filter("url is not null"), 32), "urls")
    return C.string_at(C.string_blocks(b, "url"), b.select("block_id", "idx"))


@query(f"{_NAMES} SELECT rank // 128 AS block_id, rank % 128 AS idx, url AS text, octet_length(encode(url))::BIGINT AS n_bytes FROM u")
def symbol_round_trip(spark, d):
    b = E.blocks(_table(spark, d, "pages").select("url").filter("url is not null"), 128)
    return C.decode_symbol_rows(C.symbol_blocks(b, "url")).drop("coded_bytes")


@query("WITH r AS (SELECT (row_number() OVER (ORDER BY l_quantity) - 1) // 1024 AS block_id FROM lineitem) SELECT block_id, count(*) AS n, true AS near_entropy FROM r GROUP BY 1")
def prefix_code_sizes(spark, d):
    """A prefix code takes at least the entropy, and less than one bit a value more (or one bit, of one value only)."""
    b = materialize(E.blocks(_table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("key")), 1024), "blocks")
    e = E.entropy(b, "key", "block_id")
    x = C.prefix_code_bits(b, "key").join(e, "block_id").join(b.groupBy("block_id").agg(F.count(F.lit(1)).alias("size")), "block_id")
    near = (F.col("bits") >= F.col("entropy") * F.col("size") - 0.01) & (F.col("bits") <= (F.col("entropy") + 1) * F.col("size") + 0.01)
    return x.select("block_id", F.col("size").alias("n"), near.alias("near_entropy"))


@query("SELECT true AS local_at_small_errors, true AS broad_at_large_errors")
def hard_key_segments(spark, d):
    """Keys that are hard at small errors take more segments there, keys that are hard at large ones more there."""
    out = None
    for local, broad in ((1, 1), (6, 1), (1, 8)):
        r = materialize(with_rank(workload.hard_keys(spark, 20_000, local, broad).select("key"), "key"), "hard")
        for eps in (8, 256):
            n = H.hull_segments(r, eps).agg(F.lit(local).alias("local"), F.lit(broad).alias("broad"), F.lit(eps).alias("eps"), F.count(F.lit(1)).alias("n"))
            out = n if out is None else out.unionByName(n)
    of = lambda local, broad, eps: F.max(F.when((F.col("local") == local) & (F.col("broad") == broad) & (F.col("eps") == eps), F.col("n")))
    return out.agg((of(6, 1, 8) > of(1, 1, 8)).alias("local_at_small_errors"), (of(1, 8, 256) > of(1, 1, 256)).alias("broad_at_large_errors"))


# Encodings.

_BLK = f"WITH {EV}, b AS (SELECT key, rank, rank // 256 AS block_id, rank % 256 AS idx FROM rk)"


def _bits(x):
    return f"CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END::BIGINT"


@query(f"{_BLK} SELECT block_id, count(*) AS n, min(key) AS lo, max(key) AS hi, {_bits('max(key) - min(key)')} AS bits FROM b GROUP BY 1")
def for_stats(spark, d):
    return E.frame_of_reference(E.blocks(_events(spark, d), 256))


@query(f"{_BLK}, x AS (SELECT block_id, key, coalesce(key - lag(key) OVER (PARTITION BY block_id ORDER BY idx), 0) AS delta FROM b) SELECT block_id, min(key) AS first_key, max(abs(delta)) AS most, {_bits('max(abs(delta))')} + 1 AS bits FROM x GROUP BY 1")
def delta_stats(spark, d):
    x = E.deltas(E.blocks(_events(spark, d), 256))
    return x.groupBy("block_id").agg(F.min("key").alias("first_key"), F.max(F.abs("delta")).alias("most")).withColumn("bits", bits(F.col("most")) + 1)


@query(f"{_BLK} SELECT count(*) AS n, 0::BIGINT AS wrong FROM b")
def delta_round_trip(spark, d):
    x = E.undo_deltas(E.deltas(E.blocks(_events(spark, d), 256)))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decoded") != F.col("key")).alias("wrong"))


@query("WITH e AS (SELECT event_type AS v, user_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS rank FROM events), r AS (SELECT *, rank // 256 AS part FROM e), x AS (SELECT *, rank - row_number() OVER (PARTITION BY part, v ORDER BY rank) AS g FROM r) SELECT part, min(rank) AS run_start, v AS value, count(*) AS n FROM x GROUP BY part, v, g")
def rle_runs(spark, d):
    e = _table(spark, d, "events").select(micros("ts").alias("key"), "event_id", F.col("event_type").alias("v"))
    r = with_rank(e, "key", "event_id").withColumn("part", F.expr("rank div 256"))
    return E.runs(r, "v", "rank", "part")


@query(f"{_BLK}, x AS (SELECT block_id, coalesce(key - lag(key) OVER (PARTITION BY block_id ORDER BY idx), 0) AS delta FROM b) SELECT block_id, sum(greatest(1, ({_bits('delta')} + 6) // 7))::BIGINT AS n_bytes FROM x GROUP BY 1")
def vbyte_size(spark, d):
    x = E.deltas(E.blocks(_events(spark, d), 256))
    return x.withColumn("b", bits(F.col("delta"))).groupBy("block_id").agg(F.sum(F.greatest(F.lit(1), F.expr("(b + 6) div 7"))).alias("n_bytes"))


@query(f"{_BLK}, m AS (SELECT *, (key - min(key) OVER (PARTITION BY block_id))::DOUBLE AS y FROM b) SELECT block_id, count(*) AS n, round(regr_slope(y, idx::DOUBLE) / 1e6, 4) AS slope, round(regr_intercept(y, idx::DOUBLE) / 1e9, 4) AS intercept FROM m GROUP BY 1")
def line_block_fit(spark, d):
    f = E.line_fit(E.blocks(_events(spark, d), 256))
    return f.select("block_id", "n", F.round(F.col("slope") / 1e6, 4).alias("slope"), F.round(F.col("intercept") / 1e9, 4).alias("intercept"))


@query(f"{_BLK} SELECT block_id, count(*) AS n, true AS within_range FROM b GROUP BY 1")
def line_block_sizes(spark, d):
    """The residuals of a line take no more bits, with their sign, than the range of the block's keys."""
    b = materialize(E.blocks(_events(spark, d), 256), "blocks")
    x = E.line_residuals(b, E.stored_line(E.line_fit(b))).groupBy("block_id").agg(F.max(F.abs("residual")).alias("most"), F.count(F.lit(1)).alias("n"), (F.max("key") - F.min("key")).alias("width"))
    return x.select("block_id", "n", (bits(F.col("most")) <= bits(F.col("width"))).alias("within_range"))


@query("WITH r AS (SELECT l_quantity::BIGINT AS q, (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1) // 1024 AS part FROM lineitem), c AS (SELECT part, q, count(*) AS c FROM r GROUP BY 1, 2), t AS (SELECT part, c / sum(c) OVER (PARTITION BY part) AS p FROM c) SELECT part, round(sum(-p * log2(p)), 6) AS entropy FROM t GROUP BY part")
def entropy_by_block(spark, d):
    t = _table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    r = with_rank(t, "l_shipdate", "l_orderkey", "l_linenumber", "q").select(F.col("q").cast("long").alias("q"), F.expr("rank div 1024").alias("part"))
    return E.entropy(r, "q", "part")


@query(f"WITH {EV}, g AS (SELECT unnest([64, 128, 256, 512, 1024, 2048]) AS size), s AS (SELECT size, rank // size AS blk, count(*) AS n, {_bits('max(key) - min(key)')} AS bits FROM rk, g GROUP BY 1, 2) SELECT size::BIGINT AS size, sum((n * bits + 7) // 8 + 9)::BIGINT AS n_bytes FROM s GROUP BY 1 ORDER BY n_bytes, size LIMIT 1")
def best_block_size(spark, d):
    s = reference_sizes(with_rank(_events(spark, d), "key"), [64, 128, 256, 512, 1024, 2048])
    return s.orderBy("n_bytes", "size").limit(1)


@query("WITH r AS (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 64 AS part FROM customer), m AS (SELECT part, min(c_name) AS lo, max(c_name) AS hi FROM r GROUP BY 1) SELECT part, lo, hi, coalesce((SELECT min(i) - 1 FROM range(1, 100) t(i) WHERE i <= least(length(lo), length(hi)) AND substr(lo, i, 1) <> substr(hi, i, 1)), least(length(lo), length(hi)))::BIGINT AS prefix FROM m")
def common_prefix(spark, d):
    r = with_rank(_table(spark, d, "customer").select("c_name"), "c_name").withColumn("part", F.expr("rank div 64"))
    return E.common_prefix(r, "c_name", "part")


@query(f"{_BLK}, z AS (SELECT block_id, max(key) - min(key) AS err FROM b GROUP BY 1), e AS (SELECT block_id, err // 1000000000 AS err FROM z) SELECT block_id, err, dense_rank() OVER (ORDER BY err) - 1 AS code FROM e")
def error_dictionary(spark, d):
    z = E.frame_of_reference(E.blocks(_events(spark, d), 256)).select("block_id", F.expr("(hi - lo) div 1000000000").alias("err"))
    z = materialize(z, "errors")
    codes = with_rank(z.select("err").distinct(), "err", name="code")
    return z.join(codes, "err").select("block_id", "err", "code")


# Store.

_OPS = "chg AS (SELECT range * 7919 % (2 * (SELECT count(*) FROM ord)) AS key, range * 3 AS value, range + 1 AS seq, range % 11 = 0 AS deleted FROM range(0, 4000)), base AS (SELECT key, value, 0::BIGINT AS seq, false AS deleted FROM ord), every AS (SELECT * FROM base UNION ALL SELECT * FROM chg), newest AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, arg_max(deleted, seq) AS deleted FROM every GROUP BY key)"


def _base(spark, d):
    return _orders(spark, d).select("key", "value", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"))


def _changes(spark, d):
    n = _orders(spark, d).count()
    i = F.col("id")
    return spark.range(4000).select((i * 7919 % (2 * n)).alias("key"), (i * 3).alias("value"), (i + 1).alias("seq"), (i % 11 == 0).alias("deleted"))


@query(f"WITH {ORD}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank, count(*) OVER () AS n FROM ord) SELECT key, rank % (n // 100) = 0 AND rank // (n // 100) < 100 AS in_buffer FROM r")
def hybrid_split(spark, d):
    r = with_rank(_orders(spark, d), "key")
    return ST.split(r, _orders(spark, d).count()).select("key", "in_buffer")


@query(f"WITH {ORD}, {_OPS} SELECT key, value, seq, deleted FROM newest")
def upsert_newest(spark, d):
    return ST.newest(_base(spark, d), _changes(spark, d)).select("key", "value", "seq", "deleted")


@query(f"WITH {ORD}, {_OPS} SELECT key, value, seq FROM newest WHERE NOT deleted")
def delete_tombstone(spark, d):
    return ST.live(_base(spark, d), _changes(spark, d)).select("key", "value", "seq")


@query(f"WITH {ORD}, {_OPS}, u AS (SELECT key, max(value) AS new_value FROM chg GROUP BY key) SELECT key, coalesce(new_value, value) AS value, new_value IS NOT NULL AS updated FROM ord LEFT JOIN u USING (key)")
def update_existing(spark, d):
    return ST.update_existing(_orders(spark, d), _changes(spark, d).groupBy("key").agg(F.max("value").alias("new_value")))


@query(f"WITH {ORD}, {_OPS} SELECT key, value FROM newest WHERE NOT deleted")
def merge_compact(spark, d):
    store = ST.Store(_base(spark, d), budget_rows=1000)
    ops = _changes(spark, d)
    for low in range(0, 4000, 1000):
        store = store.apply(ops.filter(f"seq > {low} and seq <= {low + 1000}"))
    return store.merge().rows().select("key", "value")


@query(f"WITH {ORD}, {_OPS}, r AS (SELECT key, row_number() OVER (ORDER BY key) AS rn FROM newest WHERE NOT deleted) SELECT count(*) AS n, count(DISTINCT key) AS n_keys, 0::BIGINT AS disordered FROM r")
def partition_merge(spark, d):
    m = materialize(ST.merge_partitions(_base(spark, d), _changes(spark, d), 8).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merged")
    w = Window.partitionBy("part").orderBy("at")
    ordered = m.withColumn("bad", F.col("key") <= F.lag("key").over(w))
    ends = m.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    overlap = ends.withColumn("bad", F.col("lo") <= F.lag("hi").over(Window.orderBy("part"))).agg(F.count_if("bad").alias("k"))
    out = ordered.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"), F.count_if("bad").alias("bad"))
    return out.join(overlap).select("n", "n_keys", (F.col("bad") + F.col("k")).alias("disordered"))


@query(f"WITH {ORD} SELECT key, value FROM ord WHERE NOT (key >= 500 AND key < 2500)")
def erase_range(spark, d):
    return _orders(spark, d).filter("not (key >= 500 and key < 2500)")


@query("SELECT l_partkey::BIGINT AS key, count(*) AS n, min(l_orderkey)::BIGINT AS first_value FROM lineitem GROUP BY 1")
def multimap_counts(spark, d):
    t = _table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("key"), F.col("l_orderkey").cast("long").alias("v"))
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first_value"))


@query(f"WITH {EV} SELECT 0::BIGINT AS disordered, 0::BIGINT AS overlapping, count(*) AS n FROM ev")
def verify_invariants(spark, d):
    r = materialize(with_pages(with_rank(_events(spark, d), "key"), 256), "paged")
    w = Window.partitionBy("page_id").orderBy("rank")
    inside = r.withColumn("bad", F.col("key") < F.lag("key").over(w)).agg(F.count_if("bad").alias("disordered"), F.count(F.lit(1)).alias("n"))
    z = zones(r)
    after = z.select((F.col("page_id") - 1).alias("page_id"), F.col("lo").alias("next_lo"))
    return inside.join(z.join(after, "page_id").agg(F.count_if(F.col("next_lo") < F.col("hi")).alias("overlapping")))


# Operation logs.


def _log_sql(kind_case, insert):
    return f"log AS (SELECT range AS op_id, {kind_case} AS op, range * 7919 % n AS k, n FROM range(0, 5000), (SELECT count(*) AS n FROM ord)), ops AS (SELECT op_id, op, CASE WHEN op = 'INSERT' THEN n + k ELSE k END AS key, CASE WHEN op IN ('INSERT', 'UPDATE') THEN op_id * 10 END AS value FROM log)"


_MIXED = _log_sql("CASE range % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'SCAN' ELSE 'INSERT' END", True)


@query(f"WITH {ORD}, {_log_sql(chr(39) + 'READ' + chr(39), False)} SELECT op_id, ops.key, ord.value FROM ops LEFT JOIN ord USING (key)")
def ycsb_read(spark, d):
    o = _orders(spark, d)
    return ST.reads_as_of(o, workload.mix(spark, 5000, o.count(), "c"))


@query(f"WITH {ORD}, {_MIXED} SELECT r.op_id, r.key, coalesce((SELECT arg_max(w.value, w.op_id) FROM ops w WHERE w.key = r.key AND w.op_id < r.op_id AND w.op IN ('INSERT', 'UPDATE')), ord.value) AS value FROM ops r LEFT JOIN ord USING (key) WHERE r.op = 'READ'")
def ycsb_asof_read(spark, d):
    o = _orders(spark, d)
    return ST.reads_as_of(o, workload.mix(spark, 5000, o.count(), "s"))


@query(f"WITH {ORD}, {_MIXED}, e AS (SELECT key, value, -1 AS w FROM ord UNION ALL SELECT key, value, op_id FROM ops WHERE value IS NOT NULL) SELECT key, arg_max(value, w) AS value FROM e GROUP BY key")
def ycsb_final_state(spark, d):
    o = _orders(spark, d)
    writes = workload.mix(spark, 5000, o.count(), "s").filter("value is not null").select("key", "value", (F.col("op_id") + 1).alias("seq"), F.lit(False).alias("deleted"))
    return ST.live(_base(spark, d), writes).select("key", "value")


@query("WITH l AS (SELECT range AS i FROM range(0, 1000)) SELECT CASE WHEN i % 3 = 0 THEN 'SCAN' ELSE 'READ' END AS op, i * 17 AS key, CASE WHEN i % 3 = 0 THEN (i % 100 + 1)::INTEGER END AS len FROM l")
def ycsb_parse(spark, d):
    i = F.col("id")
    line = F.when(i % 3 == 0, F.concat_ws(" ", F.lit("SCAN"), i * 17, i % 100 + 1)).otherwise(F.concat_ws(" ", F.lit("READ"), i * 17))
    return K.parse_operations(spark.range(1000).select(line.alias("value")))


@query("WITH l AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, user_id) AS k FROM l) SELECT user_id, last AS last_access, k <= 100 AS hot FROM r")
def hot_cold_lru(spark, d):
    last = _table(spark, d, "events").groupBy("user_id").agg(F.max(micros("ts")).alias("last_access"))
    r = with_rank(last.withColumn("_o", -F.col("last_access")), "_o", "user_id")
    return r.select("user_id", "last_access", (F.col("rank") < 100).alias("hot"))


# Points.

PT = "pt AS (SELECT p_partkey::BIGINT AS id, p_size::BIGINT AS x, round(p_retailprice * 100)::BIGINT AS y FROM part)"


def _points(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("x"), cents("p_retailprice").alias("y"))


@query("SELECT count(*) AS n, sum(l_orderkey)::DECIMAL(38,0) AS keys, max(l_orderkey)::BIGINT AS most, round(avg(l_orderkey), 4) AS mean FROM lineitem")
def checksum(spark, d):
    k = F.col("l_orderkey").cast("long")
    return _table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum(k.cast("decimal(28,0)")).cast("decimal(38,0)").alias("keys"), F.max(k).alias("most"), F.round(F.avg(k), 4).alias("mean"))
