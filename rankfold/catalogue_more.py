"""Further registered queries: encoded blocks, levelled and tiered stores, tuning, persistence, generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _FOUND, EV, ORD, PROBES, PT, _base, _changes, _events, _orders, _points, _probes, _table, query
from .functions.keys import morton_words, morton_words_axis
from .operators import codecs as C
from .operators import hulls as H
from .operators import levels as LV
from .operators.adaptive import Leaves
from .operators import models as M
from .operators import packed as P
from .operators import spatial as S
from .operators import store as ST
from .operators import tiers as TI
from .operators import tuning as TU
from .operators.lookups import zone_lookup
from .operators.ranking import asof, with_pages, with_rank, zones
from .plans import generators as G
from .plans import workload
from .session import materialize, shared_dir
from .sources import keys as K


def _u(i: str, seed: int) -> str:
    """unit() in SQL."""
    x = f"((({i}) % 1073741824 * 2654435761 + {seed * 1013904223}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
    return f"(xor({x}, {x} >> 16)::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"


def _ranked(spark, d) -> DataFrame:
    return materialize(with_rank(_events(spark, d), "key"), "ranked")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Encoded blocks: every query reads the stored rows only.

CODECS = ["copy", "for", "line", "minimax", "ends", "median", "quad", "step", "delta", "line+pack32", "for+pack32", "delta+bytes", "line+bytes", "delta+rans", "minimax+rans"]
_ALL_CODECS = ", ".join(f"('{c}')" for c in CODECS)


def _encoded(spark, d, codec="line", size=256) -> DataFrame:
    return materialize(P.encode(P.key_blocks(_events(spark, d), size), codec), "encoded")


@query(f"WITH {EV} SELECT codec, key, rank FROM rk, (VALUES {_ALL_CODECS}) c(codec)")
def encoded_round_trips(spark, d):
    arrays = materialize(P.key_blocks(_events(spark, d), 256), "arrays")
    return _union([P.decode(materialize(P.encode(arrays, c), "encoded")).select(F.lit(c).alias("codec"), "key", "rank") for c in CODECS])


@query(f"WITH {EV} SELECT key, rank FROM rk")
def line_round_trip(spark, d):
    return P.decode(_encoded(spark, d)).select("key", "rank")


@query(f"WITH {EV}, c AS (SELECT key FROM rk WHERE rank = (SELECT count(*) * 9 // 10 FROM ev)) SELECT codec, key, rank FROM rk, (VALUES ('line'), ('for'), ('delta')) v(codec) WHERE key > (SELECT key FROM c)")
def filter_gt_encoded(spark, d):
    e = materialize(with_rank(_events(spark, d), "key"), "ranked")
    cut = e.filter(F.col("rank") == e.count() * 9 // 10).first()["key"]
    return _union([P.above(_encoded(spark, d, c), cut).select(F.lit(c).alias("codec"), "key", "rank") for c in ("line", "for", "delta")])


@query(f"WITH {EV} SELECT codec, key, rank FROM rk, (VALUES ('line'), ('for')) v(codec) WHERE key % 86400000000 > 3600000000 AND key % 86400000000 < 7200000000")
def filter_modulo_encoded(spark, d):
    return _union([P.modulo(_encoded(spark, d, c), 86_400_000_000, 3_600_000_000, 7_200_000_000).select(F.lit(c).alias("codec"), "key", "rank") for c in ("line", "for")])


#: Selectivities of the bitmap, out of 100,000.
_BITMAPS = (1, 10, 100, 1000, 5000, 10_000)


@query(f"WITH {EV} SELECT p::INTEGER AS p, rank, key FROM rk, (SELECT unnest([{', '.join(map(str, _BITMAPS))}]) AS p) WHERE rank * 7919 % 100000 < p")
def bitmap_gather(spark, d):
    enc = _encoded(spark, d)
    ranks = enc.select(F.explode(F.expr("sequence(first_rank, first_rank + n - 1)")).alias("rank"))
    return _union([P.gather(enc, ranks.filter(F.col("rank") * 7919 % 100_000 < p), 256).select(F.lit(p).alias("p"), "rank", "key") for p in _BITMAPS])


@query(f"WITH {EV} SELECT codec, rank // 256 AS block_id, count(*) AS n, sum(key)::DECIMAL(38,0) AS total FROM rk, (VALUES ('line'), ('for'), ('quad'), ('delta')) v(codec) GROUP BY 1, 2")
def sum_encoded(spark, d):
    return _union([P.sums(_encoded(spark, d, c)).select(F.lit(c).alias("codec"), "block_id", "n", "total") for c in ("line", "for", "quad", "delta")])


@query(f"{PROBES} SELECT probe, (SELECT count(*) FROM ev WHERE key <= probe) AS upper FROM probes")
def encoded_upper_bound(spark, d):
    return P.upper_bound(_encoded(spark, d), _probes(_ranked(spark, d)))


@query("WITH r AS (SELECT l_partkey::BIGINT AS key, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS rank FROM lineitem) SELECT rank, key FROM r")
def unsorted_column_round_trip(spark, d):
    """A column in the order of other ones: blocks of part keys, as orders come."""
    t = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("key"))
    r = with_rank(t, "l_orderkey", "l_linenumber", "key").withColumn("block_id", F.expr("rank div 512"))
    rows = r.groupBy("block_id").agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("k"))
    arrays = rows.select("block_id", "first_rank", F.col("k.key").alias("keys"))
    return P.decode(materialize(P.encode(arrays, ["for", "delta+bytes", "line"]), "encoded"))


@query(f"WITH {EV} SELECT key, rank FROM rk")
def chosen_codec_round_trip(spark, d):
    """The codec of each block is named by a decision tree over its features."""
    arrays = materialize(P.key_blocks(_events(spark, d), 128), "arrays")
    named = P.choose_codecs(arrays, ["for", "line", "quad", "delta"])
    return P.decode(materialize(P.encode(named), "encoded")).select("key", "rank")


_PACKED = [c for c in CODECS if "rans" not in c and c != "copy"]


@query(f"WITH {EV}, b AS (SELECT count(DISTINCT rank // 256) AS blocks, count(*) AS n FROM rk) SELECT codec, blocks, n, true AS below_plain FROM b, (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _PACKED)}) v(codec)")
def codec_sizes(spark, d):
    """Bytes of each codec on the same blocks: below those of plain 64-bit numbers."""
    arrays = materialize(P.key_blocks(_events(spark, d), 256), "arrays")
    sizes = _union([P.stored_bytes(P.encode(arrays, c)) for c in _PACKED])
    return sizes.select("codec", "blocks", "n", (F.col("n_bytes") < 8 * F.col("n") + 30 * F.col("blocks")).alias("below_plain"))


_FILES = {"plain": {"parquet.enable.dictionary": "false", "compression": "none"}, "dictionary": {"parquet.enable.dictionary": "true", "compression": "none"}, "plain_zstd": {"parquet.enable.dictionary": "false", "compression": "zstd"}, "dictionary_zstd": {"parquet.enable.dictionary": "true", "compression": "zstd"}}
_OPTIONS = ", ".join(f"('{o}')" for o in _FILES)


def _files(spark, d) -> list[tuple[str, DataFrame, int]]:
    keys = with_rank(_events(spark, d), "key").select("key")
    out = []
    for name, options in _FILES.items():
        path = K.fresh_path(spark, f"files-{name}")
        keys.write.options(**options).parquet(path)
        out.append((name, spark.read.schema("key long").parquet(path), K.path_bytes(spark, path)))
    return out


@query(f"WITH {EV} SELECT option, count(*) AS n, sum(key)::DECIMAL(38,0) AS total FROM ev, (VALUES {_OPTIONS}) v(option) GROUP BY 1")
def file_options(spark, d):
    total = F.sum(F.col("key").cast("decimal(28,0)")).cast("decimal(38,0)").alias("total")
    return _union([t.agg(F.lit(name).alias("option"), F.count(F.lit(1)).alias("n"), total) for name, t, _ in _files(spark, d)])


@query("SELECT option, true AS smaller FROM (VALUES ('plain_zstd'), ('dictionary_zstd')) v(option)")
def file_sizes(spark, d):
    """Bytes of the same column in files: compression makes them smaller, with and without a dictionary."""
    size = {name: n for name, _, n in _files(spark, d)}
    return spark.createDataFrame([(f"{k}_zstd", size[f"{k}_zstd"] < size[k]) for k in ("plain", "dictionary")], "option string, smaller boolean")


# Models: granules, radix tables, errors, grids, budgets.


@query(_FOUND)
def granule_pla_lookup(spark, d):
    r = _ranked(spark, d)
    return TU.granule_lookup(r, _probes(r), materialize(M.segments(TU.granule_ends(r, 64), 8), "model"), 64)


@query(_FOUND)
def granule_spline_lookup(spark, d):
    r = _ranked(spark, d)
    return TU.granule_lookup(r, _probes(r), materialize(M.segments(TU.granule_ends(r, 64), 8, spline=True), "model"), 64)


@query(_FOUND)
def radix_spline_lookup(spark, d):
    r = _ranked(spark, d)
    return TU.radix_lookup(r, _probes(r), materialize(M.segments(r, 32, spline=True), "model"))


@query(_FOUND)
def page_spline_lookup(spark, d):
    r = _ranked(spark, d)
    return TU.radix_lookup(r, _probes(r), materialize(M.segments(r, 16, page=256, spline=True), "model"))


@query(f"WITH {EV} SELECT rank // 512 AS block_id, count(*) AS n, true AS at_most_chord FROM rk GROUP BY 1")
def least_errors(spark, d):
    """The least error of one line for each block: never above that of the chord between its ends."""
    r = _ranked(spark, d).withColumn("block_id", F.expr("rank div 512"))
    ends = r.groupBy("block_id").agg(F.min_by("key", "rank").alias("a"), F.max_by("key", "rank").alias("b"), F.min("rank").alias("r0"), F.max("rank").alias("r1"))
    off = F.abs((F.col("rank") - F.col("r0")) - (F.col("key") - F.col("a")) * (F.col("r1") - F.col("r0")) / F.greatest(F.col("b") - F.col("a"), F.lit(1)))
    chord = r.join(ends, "block_id").groupBy("block_id").agg(F.max(off).alias("chord"))
    return TU.least_errors(r, 512).join(chord, "block_id").select("block_id", "n", (F.col("error") <= F.col("chord") + 1e-6).alias("at_most_chord"))


_GRID = [64 * i for i in range(1, 35)]
_GRID_SQL = f"g AS (SELECT unnest([{', '.join(map(str, _GRID))}])::BIGINT AS size), z AS (SELECT size, rank // 64 * 64 // size AS blk, count(*) AS n, max(key) - min(key) AS w FROM rk, g GROUP BY 1, 2), s AS (SELECT size, sum((n * CASE WHEN w = 0 THEN 0 ELSE length(bin(w)) END + 7) // 8 + 9)::BIGINT AS n_bytes FROM z GROUP BY 1)"


@query(f"WITH {EV}, {_GRID_SQL} SELECT size, n_bytes FROM s")
def block_size_grid(spark, d):
    return TU.reference_sizes(_ranked(spark, d), _GRID)


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev), f AS (SELECT unnest([0, 1, 2, 4]) AS fix), s AS (SELECT unnest([0, 1, 2, 4, 8]) AS slide), p AS (SELECT fix::INTEGER AS fix, slide::INTEGER AS slide, (n + (fix + slide) * 256 - 1) // ((fix + slide) * 256) AS pages FROM n, f, s WHERE fix + slide > 0) SELECT fix, slide, pages::BIGINT AS pages, (pages * 8 + pages * slide * 4 // 2)::BIGINT AS n_bytes FROM p")
def page_slack_grid(spark, d):
    return TU.page_grid(_events(spark, d), [0, 1, 2, 4], [0, 1, 2, 4, 8], 256)


_DATASETS = {"events": "SELECT epoch_us(ts) AS key FROM events", "orders": "SELECT o_orderkey::BIGINT FROM orders", "lines": "SELECT l_orderkey::BIGINT FROM lineitem"}
_SIZES = [64, 128, 256, 512, 1024, 2048]
_PRESET = "WITH " + ", ".join(f"{n} AS (SELECT '{n}' AS dataset, key, row_number() OVER (ORDER BY key) - 1 AS rank FROM ({q}) t(key))" for n, q in _DATASETS.items())


@query(f"{_PRESET}, k AS ({' UNION ALL '.join(f'SELECT * FROM {n}' for n in _DATASETS)}), g AS (SELECT unnest({_SIZES})::BIGINT AS size), z AS (SELECT dataset, size, rank // size AS b, count(*) AS n, max(key) - min(key) AS w FROM k, g GROUP BY 1, 2, 3), s AS (SELECT dataset, size, sum((n * CASE WHEN w = 0 THEN 0 ELSE length(bin(w)) END + 7) // 8 + 9)::BIGINT AS n_bytes FROM z GROUP BY 1, 2) SELECT dataset, arg_min(size, n_bytes * 10000 + size) AS size, min(n_bytes) AS n_bytes FROM s GROUP BY 1")
def parameter_presets(spark, d):
    """The block size to use for each dataset, as the grid finds it."""
    of = {"events": _events(spark, d), "orders": _orders(spark, d).select("key"), "lines": _table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"))}
    sizes = [TU.reference_sizes(with_rank(t, "key"), _SIZES).withColumn("dataset", F.lit(n)) for n, t in of.items()]
    return _union(sizes).groupBy("dataset").agg(F.min_by("size", F.struct("n_bytes", "size")).alias("size"), F.min("n_bytes").alias("n_bytes"))


_COUNTS = [(4, 5000), (16, 1200), (64, 310), (256, 80)]


@query(f"WITH c AS (SELECT ln(e) AS x, ln(n) AS y FROM (VALUES {', '.join(map(str, _COUNTS))}) t(e, n)), f AS (SELECT regr_slope(y, x) AS b, exp(regr_intercept(y, x)) AS a FROM c) SELECT round(a * 1000)::BIGINT AS a_milli, round(b * 1000000)::BIGINT AS b_micro, round(pow(4096 / (a * 16), 1 / b) * 1000)::BIGINT AS space_eps_milli, 383::BIGINT AS time_eps FROM f")
def error_budgets(spark, d):
    """The error that a space budget of 4,096 bytes and a time budget of four pages allow."""
    t = TU.tune(_COUNTS, 4096, 4, 256)
    return spark.createDataFrame([(round(t["a"] * 1000), round(t["b"] * 1_000_000), round(t["space_eps"] * 1000), int(t["time_eps"]))], "a_milli long, b_micro long, space_eps_milli long, time_eps long")


@query(f"WITH {EV} SELECT name, n, n_bytes FROM (SELECT 'data' AS name, count(*) AS n, (count(*) * 16)::BIGINT AS n_bytes FROM ev UNION ALL SELECT 'zones', count(*), (count(*) * 16)::BIGINT FROM (SELECT DISTINCT rank // 256 FROM rk))")
def space_metrics(spark, d):
    return TU.index_metrics(_ranked(spark, d), 256, {})


@query(f"WITH {EV} SELECT count(*) AS n, count(DISTINCT rank // 256) AS pages, true AS hull_is_least, true AS models_below_data FROM rk")
def model_metrics(spark, d):
    """Rows and pages beside the models at one error: the longest segments are the fewest, and all are smaller than the data."""
    r = _ranked(spark, d)
    m = TU.index_metrics(r, 256, {"cone": M.segments(r, 32), "spline": M.segments(r, 32, spline=True), "hull": H.hull_segments(r, 32)})
    of = lambda name, c="n": F.max(F.when(F.col("name") == name, F.col(c)))
    return materialize(m, "metrics").agg(
        of("data").alias("n"), of("zones").alias("pages"), ((of("hull") <= of("cone")) & (of("hull") <= of("spline"))).alias("hull_is_least"),
        (F.greatest(of("cone", "n_bytes"), of("spline", "n_bytes"), of("hull", "n_bytes")) < of("data", "n_bytes")).alias("models_below_data"),
    )


# Sources, sinks and persisted models.


@query(f"WITH {EV} SELECT key, rank, rank // 256 AS page_id, rank // 4096 AS file_id FROM rk WHERE rank // 256 % 3 = 1")
def stored_page_reads(spark, d):
    """Pages written to a folder for each file of pages, and some read back: other folders are pruned."""
    path = K.fresh_path(spark, "pages")
    K.write_page_files(with_pages(with_rank(_events(spark, d), "key"), 256), path)
    return K.read_page_files(spark, path, "key long, rank long, page_id long", F.col("page_id") % 3 == 1)


_FILE_KEYS = "SELECT (range::DECIMAL(38,0) * range * 3 + 7 + CASE WHEN range % 100 = 0 THEN 9223372036854775808 ELSE 0 END)::DECIMAL(20,0) AS key FROM range(0, 5000)"


def _file_keys() -> list[int]:
    return [i * i * 3 + 7 + (1 << 63 if i % 100 == 0 else 0) for i in range(5000)]


@query(_FILE_KEYS)
def binary_key_file(spark, d):
    path = K.fresh_path(spark, "keys") + "/keys.bin"
    K.write_file(spark, path, np.array([5000, *_file_keys()], "<u8").tobytes())
    return K.read_keys(spark, path)


@query(f"SELECT count(*) AS n, (SELECT sum(key)::DECIMAL(38,0) FROM ({_FILE_KEYS})) AS expected, sum(key)::DECIMAL(38,0) AS total FROM ({_FILE_KEYS})")
def checked_key_file(spark, d):
    """A key file whose header holds the sum of its keys, modulo 2^64, here split into two words."""
    keys, path = _file_keys(), K.fresh_path(spark, "keys") + "/checked.bin"
    total = sum(keys)
    K.write_file(spark, path, np.array([len(keys), total >> 64, total & (1 << 64) - 1, *keys], "<u8").tobytes())
    high, low = K.header_words(spark, path, 3)[1:]
    expected = F.lit(str((high << 64) + low)).cast("decimal(38,0)").alias("expected")
    return K.read_keys(spark, path, skip=3).agg(F.count(F.lit(1)).alias("n"), expected, F.sum("key").cast("decimal(38,0)").alias("total"))


@query("SELECT range AS at, (range * 977 + 5)::DECIMAL(20,0) AS key FROM range(0, 3000)")
def strided_record_file(spark, d):
    """Records of 24 bytes with the key at their head."""
    path = K.fresh_path(spark, "records") + "/records.bin"
    records = np.zeros((3000, 3), "<u8")
    records[:, 0] = np.arange(3000) * 977 + 5
    K.write_file(spark, path, records.tobytes())
    return K.read_keys(spark, path, skip=0, record_bytes=24, place="at")


@query("SELECT (range * 31 - 1000)::BIGINT AS key FROM range(0, 2000)")
def text_key_file(spark, d):
    path = K.fresh_path(spark, "text-keys")
    spark.range(2000).select((F.col("id") * 31 - 1000).cast("string").alias("value")).write.text(path)
    return K.read_text_keys(spark, path)


_S_OPS = "SELECT range AS op_id, CASE range % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::INTEGER AS op, CASE WHEN range % 4 = 3 THEN 500 + range * 7919 % 500 ELSE range * 7919 % 500 END AS key, CASE WHEN range % 4 = 2 THEN (range % 100 + 1)::INTEGER END AS len FROM range(0, 2000)"


@query(_S_OPS)
def operation_streams(spark, d):
    """Operations written as three streams of codes, keys and range lengths, and joined again by their place."""
    path = K.fresh_path(spark, "streams")
    K.write_streams(workload.mix(spark, 2000, 500, "s"), path)
    return K.read_streams(spark, path)


@query(_FOUND)
def reopened_model_lookup(spark, d):
    """Keys and model written under one path and opened by it alone."""
    r, path = _ranked(spark, d), K.fresh_path(spark, "index")
    K.save_index(path, r.select("key", "rank"), H.hull_segments(r, 16))
    data, model = K.open_index(spark, path)
    return H.find_ranks(data, _probes(data), model)


@query(f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS wrong FROM ev")
def model_bytes_round_trip(spark, d):
    """A spline model as bytes, read back, and every key's rank within the error that it states."""
    r = _ranked(spark, d)
    model = K.model_of_bytes(materialize(K.bytes_of_model(M.segments(r, 32, spline=True)), "model-bytes"))
    found = asof(r, model, "key", "first_key", ["slope", "first_rank", "max_err"])
    off = F.abs(F.col("first_rank") + F.floor(F.col("slope") * (F.col("key") - F.col("found_key"))) - F.col("rank"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(off > F.col("max_err"), F.lit(True))).alias("wrong"))


@query(f"WITH {EV} SELECT rank, key FROM rk WHERE rank % 64 = 0")
def strided_reads(spark, d):
    return _ranked(spark, d).filter("rank % 64 = 0").select("rank", "key")


@query(f"WITH {EV}, s AS (SELECT rank // 100 AS block_id, 1000 + rank // 100 % 7 * 1500 AS n FROM rk GROUP BY 1, 2), b AS (SELECT block_id, n, sum(n) OVER (ORDER BY block_id) - n AS a FROM s) SELECT block_id, ((a + n - 1) // 4096 - a // 4096 + 1)::BIGINT AS pages FROM b")
def compressed_block_fetch(spark, d):
    """Pages of 4,096 bytes that a block of variable size lies on, by the seek table."""
    s = _ranked(spark, d).select(F.expr("rank div 100").alias("block_id")).distinct().withColumn("n", 1000 + F.col("block_id") % 7 * 1500)
    b = G.running_sum(s, "n", "block_id", "stop")
    return b.select("block_id", F.expr("(stop - 1) div 4096 - (stop - n) div 4096 + 1").alias("pages"))


# Probes and their expected answers.


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev), p AS (SELECT range AS op_id, range * 7919 % n AS rank FROM range(0, 5000), n), w AS (SELECT rk.key, least(rk.rank + 40, n - 1) - greatest(rk.rank - 25, 0) + 1 AS len FROM p JOIN rk USING (rank), n) SELECT count(*) AS n, sum(len)::BIGINT AS total_len, max(len)::BIGINT AS max_len, sum(key)::DECIMAL(38,0) AS total FROM w")
def expected_answers(spark, d):
    """What a batch of probes must find: lengths of their search windows and the sum of their keys."""
    r = _ranked(spark, d)
    n = r.count()
    p = materialize(workload.uniform_ranks(spark, 5000, n), "probes").join(r, "rank")
    length = F.least(F.col("rank") + 40, F.lit(n - 1)) - F.greatest(F.col("rank") - 25, F.lit(0)) + 1
    return p.select("key", length.alias("len")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total_len"), F.max("len").alias("max_len"), F.sum(F.col("key").cast("decimal(28,0)")).cast("decimal(38,0)").alias("total"))


# Levelled and tiered stores.

_LOAD = f"WITH {ORD}, chg AS (SELECT range * 7919 % (2 * (SELECT count(*) FROM ord)) AS key, range * 3 AS value, range + 1 AS seq, range % 11 = 0 AS deleted FROM range(0, 4000)), every AS (SELECT key, value, 0::BIGINT AS seq, false AS deleted FROM ord UNION ALL SELECT * FROM chg), live AS (SELECT key, arg_max(value, seq) AS value FROM every GROUP BY key HAVING NOT arg_max(deleted, seq))"


def _levels(spark, d) -> LV.Levels:
    store = LV.Levels(spark, buffer_rows=300, base=4).insert(_base(spark, d))
    changes = _changes(spark, d)
    for low in range(0, 4000, 1000):
        store = store.insert(changes.filter(f"seq > {low} and seq <= {low + 1000}"))
    return store


@query(f"{_LOAD} SELECT row_number() OVER (ORDER BY key) - 1 AS at, key, value FROM live")
def levels_ordered(spark, d):
    return _levels(spark, d).ordered()


@query(f"{_LOAD}, p AS (SELECT range AS probe FROM range(0, (SELECT 2 * count(*) FROM ord)) WHERE range % 20 = 0) SELECT probe, value FROM p LEFT JOIN live ON key = probe")
def levels_find(spark, d):
    n = _orders(spark, d).count()
    return _levels(spark, d).find(spark.range(0, 2 * n, 20).select(F.col("id").alias("probe")))


@query(f"{_LOAD} SELECT key, value FROM live WHERE key BETWEEN 500 AND 9000")
def levels_range(spark, d):
    return _levels(spark, d).between(500, 9000)


@query(f"{_LOAD}, p AS (SELECT range + 3 AS probe FROM range(0, (SELECT 2 * count(*) + 40 FROM ord)) WHERE range % 20 = 0), c AS (SELECT probe, (SELECT min(key) FROM live WHERE key >= probe) AS key FROM p) SELECT probe, key, value FROM c LEFT JOIN live USING (key)")
def levels_lower_bound(spark, d):
    n = _orders(spark, d).count()
    return _levels(spark, d).lower_bound(spark.range(0, 2 * n + 40, 20).select((F.col("id") + 3).alias("probe")))


@query(f"{_LOAD} SELECT count(*) AS live, 0::BIGINT AS over_full, 0::BIGINT AS hidden FROM live")
def levels_invariants(spark, d):
    """No level holds more than its capacity, nor two versions of a key; the live rows are as many as the SQL's."""
    s = _levels(spark, d)
    over = sum(x.n > s.capacity(i) for i, x in enumerate(s.levels) if x)
    twice = sum(x.n - x.rows.select("key").distinct().count() for x in s.levels if x)
    return spark.createDataFrame([(s.size(), over, twice)], "live long, over_full long, hidden long")


@query(f"WITH {ORD}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank, count(*) OVER () AS n FROM ord) SELECT key, rank % greatest(1, n // 50) = 0 AND rank // greatest(1, n // 50) < 50 AS kept FROM r")
def buffer_drain(spark, d):
    kept, gone = LV.drain(_base(spark, d), 50)
    return kept.select("key", F.lit(True).alias("kept")).unionByName(gone.select("key", F.lit(False).alias("kept")))


@query("SELECT writer, published FROM (VALUES ('first', true), ('second', false), ('retry', true)) t(writer, published)")
def publish_once(spark, d):
    """Two writers start from one version: the first to publish wins, the other has to start anew from its version."""
    base = LV.Levels(spark, buffer_rows=1000)
    ops = _changes(spark, d)
    name = K.fresh_path(spark, "published").rsplit("/", 1)[1]
    a, b = base.insert(ops.filter("seq <= 100")), base.insert(ops.filter("seq > 100 and seq <= 200"))
    told = [("first", a.publish(name)), ("second", b.publish(name)), ("retry", a.insert(ops.filter("seq > 100 and seq <= 200")).publish(name))]
    return spark.createDataFrame(told, "writer string, published boolean")


@query(f"{_LOAD} SELECT key, value FROM live")
def store_dump_restore(spark, d):
    """All live rows written, read back into an empty store, and read from that."""
    path = K.fresh_path(spark, "dump")
    _levels(spark, d).rows().write.parquet(path)
    back = spark.read.schema("key long, value long, seq long").parquet(path).withColumn("deleted", F.lit(False))
    return LV.Levels(spark, buffer_rows=500).insert(back).rows().select("key", "value")


@query(f"WITH RECURSIVE {ORD}, t(level, pages) AS (SELECT 0, (SELECT (count(*) + 178) // 179 FROM ord) UNION ALL SELECT level + 1, (pages + 255) // 256 FROM t WHERE pages > 1) SELECT level::INTEGER AS level, pages::BIGINT AS pages FROM t")
def bulk_loaded_tree(spark, d):
    """Pages on the levels of a tree that is loaded at once, leaves filled to 0.7 of 256 records."""
    pages = TU.tree_levels(_orders(spark, d).count(), 256, 0.7, 256)
    return spark.createDataFrame(list(enumerate(pages)), "level int, pages long")


LOCATORS = ("zone", "cone", "spline", "radix", "hull")


def _located(spark, d, locator: str) -> DataFrame:
    """Reads of the operation log, each answered through one index."""
    o = materialize(_orders(spark, d), "orders")
    ops = workload.mix(spark, 4000, 2 * o.count(), "c").select("op_id", "key")
    probes = ops.select(F.col("key").alias("probe")).distinct()
    if locator == "zone":
        found = zone_lookup(o, probes).select("probe", "value")
    else:
        r = materialize(with_rank(o, "key"), "ranked")
        if locator == "radix":
            ranks = TU.radix_lookup(r, probes, materialize(M.segments(r, 32, spline=True), "model"))
        elif locator == "hull":
            ranks = H.find_ranks(r, probes, materialize(H.hull_segments(r, 32), "model"))
        else:
            ranks = M.model_lookup(o.select("key"), probes, 32, spline=locator == "spline")
        found = ranks.join(r.select("rank", "value"), "rank", "left").select("probe", "value")
    return ops.join(found, F.col("key") == F.col("probe"), "left").select(F.lit(locator).alias("locator"), "op_id", "key", "value")


@query(f"WITH {ORD}, ops AS (SELECT range AS op_id, range * 7919 % (SELECT 2 * count(*) FROM ord) AS key FROM range(0, 4000)) SELECT locator, op_id, key, value FROM ops LEFT JOIN ord USING (key), (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in LOCATORS)}) v(locator)")
def located_reads(spark, d):
    return _union([_located(spark, d, x) for x in LOCATORS])


@query(f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS misfiled, true AS full_told FROM rk WHERE rank % 3 = 1")
def segment_buffers(spark, d):
    """Inserts filed in the buffers of the segments that cover them; buffers above 20 rows ask for a new fit."""
    r = _ranked(spark, d)
    model = materialize(M.segments(r.filter("rank % 3 <> 1").select("key", F.expr("rank - (rank + 1) div 3").alias("rank")), 16), "model")
    filed, sizes = TI.segment_buffers(model, r.filter("rank % 3 = 1").select("key", F.col("rank").alias("value")), 20)
    ends = asof(model.select("first_key", (-F.col("first_key")).alias("_d")), model.select((-F.col("first_key")).alias("_k"), F.col("first_key").alias("next")), "_d", "_k", ["next"], strict=True)
    wrong = filed.join(ends.select("first_key", "next"), "first_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("key") >= F.col("next"), F.lit(False))).alias("misfiled"))
    return wrong.join(sizes.agg(F.bool_and(F.col("full") == (F.col("n") > 20)).alias("full_told")))


_TIER = f"WITH {ORD}, n AS (SELECT count(*) AS n FROM ord), b AS (SELECT key, value, CASE WHEN key % 50 = 0 THEN 10000000 + key ELSE key * 7919 % n END AS last FROM ord, n WHERE key % 10 <> 3), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, key) AS k FROM b), top AS (SELECT max(key) AS top FROM r WHERE k <= 700), p AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 256 AS page_id FROM r WHERE k > 700), l AS (SELECT key, value, CASE WHEN key <= top THEN 'late' ELSE 'memory' END AS tier FROM ord, top WHERE key % 10 = 3)"


@query(f"{_TIER}, a AS (SELECT r.key, value, CASE WHEN k <= 700 THEN 'memory' ELSE 'disk' END AS tier, page_id FROM r LEFT JOIN p USING (key) UNION ALL SELECT key, value, tier, NULL FROM l) SELECT key, value, tier, page_id FROM a WHERE key BETWEEN 1000 AND 12000")
def tiered_range(spark, d):
    """Hot rows in memory, cold ones in pages, and rows that came out of order after the eviction."""
    o = materialize(_orders(spark, d), "orders")
    n = o.count()
    start = TI.Tiered(o.filter("key % 10 <> 3").withColumn("last_access", F.col("key") * 7919 % n), capacity=700)
    evicted = start.touch(o.filter("key % 50 = 0").select("key", (F.col("key") + 10_000_000).alias("at"))).evict()
    return evicted.append(o.filter("key % 10 = 3").withColumn("last_access", F.lit(0).cast("long"))).between(1000, 12_000)


@query(f"WITH {ORD}, t AS (SELECT key, value, 0 AS s FROM ord WHERE key % 3 = 0 UNION ALL SELECT key, value, 1 FROM ord WHERE key % 4 = 0 UNION ALL SELECT key, value, 2 FROM ord WHERE key % 5 = 0) SELECT s::INTEGER AS s, key, value, row_number() OVER (ORDER BY key, s) - 1 AS at FROM t")
def merge_sorted(spark, d):
    o = _orders(spark, d)
    return LV.merge_sorted(*[o.filter(F.col("key") % k == 0).withColumn("s", F.lit(i)) for i, k in enumerate((3, 4, 5))], by=("key", "s"))


@query(f"WITH {ORD}, l AS (SELECT DISTINCT l_orderkey::BIGINT AS key FROM lineitem), o AS (SELECT DISTINCT key FROM ord) SELECT (SELECT count(*) FROM o ANTI JOIN l USING (key)) AS left_only, (SELECT count(*) FROM l ANTI JOIN o USING (key)) AS right_only, (SELECT count(*) FROM l JOIN o USING (key)) AS both_sides")
def container_compare(spark, d):
    """Keys that only one of two containers holds, in one pass over both."""
    a = _orders(spark, d).select("key", F.lit(1).alias("side"))
    b = _table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"), F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("key").agg(F.bit_or("side").alias("sides"))
    count = lambda s, name: F.count_if(F.col("sides") == s).alias(name)
    return sides.agg(count(1, "left_only"), count(2, "right_only"), count(3, "both_sides"))


# Points.


def _points4(spark, d) -> DataFrame:
    return _points(spark, d).select("id", "x", F.expr("y div 100").alias("y"), F.col("id").alias("z3"), (F.col("id") * 31 % 97).alias("z4"))


@query(f"WITH {PT} SELECT id, x, y FROM pt WHERE x BETWEEN 10 AND 30 AND y BETWEEN 95000 AND 140000")
def box_query(spark, d):
    return S.box(S.z_ordered(_points(spark, d)), [10, 95_000], [30, 140_000]).select("id", "x", "y")


@query(f"WITH {PT} SELECT id FROM pt WHERE x BETWEEN 5 AND 40 AND y // 100 BETWEEN 900 AND 1500 AND id BETWEEN 20 AND 900")
def box_query_3d(spark, d):
    axes = ("x", "y", "z3")
    return S.box(S.z_ordered(_points4(spark, d), axes), [5, 900, 20], [40, 1500, 900], axes).select("id")


@query(f"WITH {PT} SELECT id FROM pt WHERE x BETWEEN 5 AND 40 AND y // 100 BETWEEN 900 AND 1500 AND id BETWEEN 20 AND 900 AND id * 31 % 97 BETWEEN 10 AND 80")
def box_query_4d(spark, d):
    axes = ("x", "y", "z3", "z4")
    return S.box(S.z_ordered(_points4(spark, d), axes, 15), [5, 900, 20, 10], [40, 1500, 900, 80], axes, 15).select("id")


@query(f"WITH {PT} SELECT id, x, y // 100 AS y, id AS z3 FROM pt")
def morton_round_trip(spark, d):
    """Ids grow with the table, so codes take every bit of a BIGINT."""
    z = _points4(spark, d).select("id", morton_words([F.col("x"), F.col("y"), F.col("z3")]).alias("z"))
    return z.select("id", *[morton_words_axis(F.col("z"), i, 3).alias(a) for i, a in enumerate(("x", "y", "z3"))])


@query(f"WITH {PT}, q AS (SELECT id AS query, x + 1 AS qx, y - 37 AS qy FROM pt WHERE id % 20 = 0), dd AS (SELECT query, id, ((x - qx) * (x - qx) + (y - qy) * (y - qy))::BIGINT AS dist FROM pt, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS pos FROM dd) SELECT query, id, dist, pos::INTEGER AS pos FROM r WHERE pos <= 5")
def knn_exact(spark, d):
    p = _points(spark, d)
    return S.nearest(p, p.filter("id % 20 = 0").select(F.col("id").alias("query"), (F.col("x") + 1).alias("x"), (F.col("y") - 37).alias("y")), 5)


# Generators.


@query(f"SELECT 'linear' AS kind, range AS id, range * 7 + 100 AS value FROM range(0, 20000) UNION ALL SELECT 'stepwise', range, (3 + 5 * (range % 10000) + floor({_u('range', 5)} * 7) - 3)::BIGINT FROM range(0, 20000) UNION ALL SELECT 'normal', range, round(1e6::DOUBLE + 1e5::DOUBLE * sqrt(-2 * ln({_u('range', 7)})) * cos(2 * pi() * {_u('range', 8)}))::BIGINT FROM range(0, 20000) UNION ALL SELECT 'arrivals', range, sum(round(-1000 * ln({_u('range', 9)}))::BIGINT) OVER (ORDER BY range)::BIGINT FROM range(0, 20000)")
def generated_columns(spark, d):
    made = {"linear": G.linear, "stepwise": G.stepwise, "normal": G.normal, "arrivals": G.arrivals}
    return _union([f(spark, 20_000).select(F.lit(k).alias("kind"), "id", "value") for k, f in made.items()])


@query(f"SELECT 'uniform' AS kind, range AS id, floor({_u('range', 1)} * 1000000)::BIGINT AS key FROM range(0, 10000) UNION ALL SELECT 'binomial', range, bit_count(floor({_u('range', 2)} * 4294967296)::BIGINT)::BIGINT FROM range(0, 10000) UNION ALL SELECT 'geometric', range, floor(ln({_u('range', 3)}) / ln(1 - 0.01))::BIGINT FROM range(0, 10000)")
def generated_keys(spark, d):
    made = {"uniform": G.uniform_keys(spark, 10_000, 1_000_000), "binomial": G.binomial_keys(spark, 10_000), "geometric": G.geometric_keys(spark, 10_000)}
    return _union([t.select(F.lit(k).alias("kind"), "id", "key") for k, t in made.items()])


_ZIPF = f"least(floor(pow({_u('range', 1)} * (pow(1000, 1 - 0.99) - 1) + 1, 1 / (1 - 0.99))) - 1, 999)::BIGINT"


@query(f"SELECT {_ZIPF} AS rank, count(*) AS n FROM range(0, 5000) GROUP BY 1")
def zipf_workload(spark, d):
    return workload.zipf_ranks(spark, 5000, 1000).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT ({_ZIPF} * 2654435761 + 12345) % 1000 AS rank, count(*) AS n FROM range(0, 5000) GROUP BY 1")
def scrambled_zipf_workload(spark, d):
    return workload.zipf_ranks(spark, 5000, 1000, scrambled=True).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT least(CASE WHEN {_u('range', 1)} < 0.9::DOUBLE THEN floor({_u('range', 2)} * 200) ELSE 200 + floor({_u('range', 2)} * 800) END, 999)::BIGINT AS rank, count(*) AS n FROM range(0, 5000) GROUP BY 1")
def hotspot_workload(spark, d):
    return workload.hotspot_ranks(spark, 5000, 1000).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT range AS op_id, range * 7919 % 1000 AS rank, least(range * 7919 % 1000 + floor({_u('range', 13)} * 101)::BIGINT, 999) AS last FROM range(0, 3000)")
def uniform_ranges(spark, d):
    return G.ranges(workload.uniform_ranks(spark, 3000, 1000), 1000)


@query(f"WITH z AS (SELECT range AS op_id, {_ZIPF} AS rank FROM range(0, 3000)) SELECT op_id, rank, least(rank + floor({_u('op_id', 13)} * 101)::BIGINT, 999) AS last FROM z")
def zipf_ranges(spark, d):
    return G.ranges(workload.zipf_ranks(spark, 3000, 1000), 1000)


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev), t AS (SELECT key, rank * 7919 % n AS turn, n FROM rk, n) SELECT key, true AS init, row_number() OVER (ORDER BY key) - 1 AS value, NULL::BIGINT AS op_id FROM t WHERE turn < n // 2 UNION ALL SELECT key, false, NULL, turn - n // 2 FROM t WHERE turn >= n // 2")
def init_split(spark, d):
    r = _ranked(spark, d)
    n = r.count()
    return G.init_split(r, n // 2, n)


@query(f"WITH {EV} SELECT key, rank, {_u('rank', 21)} < 0.1::DOUBLE AS late, rank * 2 + CASE WHEN {_u('rank', 21)} < 0.1::DOUBLE THEN 101 ELSE 0 END AS turn FROM rk")
def out_of_order_stream(spark, d):
    return G.out_of_order(_ranked(spark, d))


@query(f"WITH {EV}, e AS (SELECT count(*) AS n, min(key) AS lo, max(key) AS hi FROM ev), o AS (SELECT range AS op_id, {_u('range', 31)} < 0.6::DOUBLE AS here, floor({_u('range', 32)} * n)::BIGINT AS rank, (lo + floor({_u('range', 33)} * (hi - lo + 1)))::BIGINT AS anyk FROM range(0, 1000), e) SELECT op_id, CASE WHEN here THEN key ELSE anyk END AS probe FROM o JOIN rk USING (rank)")
def mixed_probes(spark, d):
    r = _ranked(spark, d)
    n, lo, hi = r.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    return G.probe_mix(spark, r, 1000, 0.6, lo, hi, n)


_HARD = f"a AS (SELECT range AS p, ceil(pow(2, {_u('range // 64', 11)} * 8) * pow(2, {_u('range', 12)} * 6))::BIGINT AS gap FROM range(0, 157)), f AS (SELECT p, gap, (sum(gap) OVER (ORDER BY p) - gap) * 64 AS first FROM a)"


@query(f"WITH {_HARD} SELECT range AS id, (first + range % 64 * gap)::BIGINT AS key FROM range(0, 10000) JOIN f ON p = range // 64")
def hard_keys(spark, d):
    return workload.hard_keys(spark, 10_000, 6, 8)


for _mix, _case in (("cc", "'INSERT'"), ("aa", "CASE WHEN range % 2 = 0 THEN 'READ' ELSE 'INSERT' END")):

    def _final(mix):
        def run(spark, d):
            o = _orders(spark, d)
            writes = workload.mix(spark, 3000, o.count(), mix).filter("value is not null").select("key", "value", (F.col("op_id") + 1).alias("seq"), F.lit(False).alias("deleted"))
            return ST.live(_base(spark, d), writes).select("key", "value")

        return run

    _run = _final(_mix)
    _run.__name__ = f"ycsb_{_mix}_final_state"
    query(f"WITH {ORD}, n AS (SELECT count(*) AS n FROM ord), o AS (SELECT range AS op_id, {_case} AS op, range * 7919 % n AS k, n FROM range(0, 3000), n), e AS (SELECT key, value, -1 AS w FROM ord UNION ALL SELECT n + k, op_id * 10, op_id FROM o WHERE op = 'INSERT') SELECT key, arg_max(value, w) AS value FROM e GROUP BY key")(_run)


# Leaves that split, slack separators, ascending numbers, further lookups.


def _leaves(spark, d) -> Leaves:
    """Every third order loaded, the rest inserted in two batches, and a range erased."""
    o = materialize(_orders(spark, d), "orders")
    t = Leaves.load(o.filter("key % 3 = 0"), capacity=64)
    return t.insert(o.filter("key % 3 = 1")).insert(o.filter("key % 3 = 2 or key % 30 = 0").withColumn("value", F.col("value") + 1)).erase(500, 900)


_LEAVES = f"WITH {ORD}, live AS (SELECT key, value + CASE WHEN key % 3 = 2 OR key % 30 = 0 THEN 1 ELSE 0 END AS value FROM ord WHERE NOT (key >= 500 AND key < 900))"


@query(f"{_LEAVES} SELECT count(*) AS n, 0::BIGINT AS over_full, 0::BIGINT AS overlapping FROM live")
def leaf_invariants(spark, d):
    leaves = materialize(_leaves(spark, d).leaves(), "leaves")
    after = asof(leaves.select("leaf", "hi", "n", (-F.col("lo")).alias("_d")), leaves.select((-F.col("lo")).alias("_k"), F.col("lo").alias("next")), "_d", "_k", ["next"], strict=True)
    return after.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 64).alias("over_full"), F.count_if(F.col("next") <= F.col("hi")).alias("overlapping"))


@query(f"{_LEAVES}, p AS (SELECT range AS probe FROM range(0, (SELECT 2 * count(*) FROM ord)) WHERE range % 20 = 0) SELECT probe, value FROM p LEFT JOIN live ON key = probe")
def leaf_find(spark, d):
    n = _orders(spark, d).count()
    return _leaves(spark, d).find(spark.range(0, 2 * n, 20).select(F.col("id").alias("probe")))


@query(_FOUND)
def slack_separator_lookup(spark, d):
    r = _ranked(spark, d)
    return H.slack_lookup(r, _probes(r), *H.slack_separators(r, 32, 1, 2), 32, 1, 2)


@query(f"WITH {EV} SELECT key, rank FROM rk")
def ascending_round_trip(spark, d):
    return P.decode_ascending(materialize(P.encode_ascending(P.key_blocks(_events(spark, d), 256)), "ascending")).select("key", "rank")


@query(f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS wrong FROM (SELECT DISTINCT rank // 64 AS g FROM rk)")
def intercept_round_trip(spark, d):
    """First ranks of granules, as a model's intercepts, kept as ascending numbers and read back."""
    r = _ranked(spark, d).groupBy(F.expr("rank div 64").alias("g")).agg(F.min("rank").alias("key"))
    arrays = materialize(P.key_blocks(r.select("key"), 64), "intercepts")
    back = P.decode_ascending(materialize(P.encode_ascending(arrays), "ascending")).withColumnRenamed("rank", "g")
    return r.withColumnRenamed("key", "own").join(back, "g", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("own").eqNullSafe(F.col("key"))).alias("wrong"))


@query("WITH r AS (SELECT l_orderkey::BIGINT AS key, row_number() OVER (ORDER BY l_orderkey) - 1 AS rank FROM lineitem), p AS (SELECT DISTINCT key AS probe FROM r WHERE key % 20 = 0) SELECT probe, min(rank) AS rank FROM p JOIN r ON key = probe GROUP BY probe")
def radix_multimap_lookup(spark, d):
    """First entries of keys with several, through a spline and its radix table."""
    t = _table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key"))
    r = materialize(with_rank(t, "key"), "ranked")
    return TU.radix_lookup(r, t.filter("key % 20 = 0").select(F.col("key").alias("probe")).distinct(), materialize(M.segments(r, 16, spline=True), "model"))


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev), w AS (SELECT key, greatest(rank - 300, 0) // 256 AS p0, least(rank + 420, n - 1) // 256 AS p1, n FROM rk, n WHERE rank % 20 = 0) SELECT key, (p1 - p0 + 1)::BIGINT AS pages, (least((p1 + 1) * 256, n) - p0 * 256)::BIGINT AS records FROM w")
def fetched_records(spark, d):
    """The pages of each search window joined with the table of pages: what a worst-case fetch brings."""
    r = materialize(with_pages(_ranked(spark, d), 256), "paged")
    n = r.count()
    low, high = F.greatest(F.col("rank") - 300, F.lit(0)), F.least(F.col("rank") + 420, F.lit(n - 1))
    wanted = r.filter("rank % 20 = 0").withColumn("low", low).withColumn("high", high).select("key", F.explode(F.expr("sequence(low div 256, high div 256)")).alias("page_id"))
    got = wanted.join(zones(r).select("page_id", "n"), "page_id")
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("records"))


@query(f"{_LOAD}, p AS (SELECT range AS probe FROM range(0, (SELECT 2 * count(*) FROM ord)) WHERE range % 20 = 0) SELECT probe, value FROM p LEFT JOIN live ON key = probe")
def merged_and_refitted_lookup(spark, d):
    """A merge writes the static part anew, and the model is fitted to it: lookups go through that model."""
    store = ST.Store(_base(spark, d), budget_rows=ST.budget_rows(40_000, 8_000)).apply(_changes(spark, d)).merge()
    data = materialize(store.rows().select("key", "value"), "merged")
    r = materialize(with_rank(data, "key"), "ranked")
    n = _orders(spark, d).count()
    probes = spark.range(0, 2 * n, 20).select(F.col("id").alias("probe"))
    ranks = H.find_ranks(r, probes, materialize(H.hull_segments(r, 32), "model"))
    return ranks.join(r.select("rank", "value"), "rank", "left").select("probe", "value")


@query("WITH m AS (SELECT l_partkey::BIGINT AS key, l_orderkey::BIGINT AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem) SELECT key, count(*) AS n, min(value) AS first_value FROM m WHERE NOT (key % 5 = 0 AND i = 1) AND key % 7 <> 0 GROUP BY key")
def multimap_erase(spark, d):
    """Of some keys the first entry is erased, of others all; what is left keeps its order."""
    t = _table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("key"), F.col("l_orderkey").cast("long").alias("value"), "l_linenumber")
    t = t.filter("key % 7 <> 0")
    first = t.filter("key % 5 = 0").groupBy("key").agg(F.min(F.struct("value", "l_linenumber")).alias("f")).select("key", "f.*")
    left = t.join(first, ["key", "value", "l_linenumber"], "left_anti")
    return left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"))


_FORMS = ", ".join(f"('{f}')" for f in C.FORMS)


@query(f"SELECT form, c_name AS text, c_name AS back FROM customer, (VALUES {_FORMS}) v(form)")
def text_forms_round_trip(spark, d):
    """Names as integers in three forms, and back."""
    chars = "".join(chr(c) for c in range(32, 127))
    return C.text_forms(_table(spark, d, "customer"), "c_name", chars, 32).select("form", "text", "back")


@query(f"SELECT form, count(*) AS n, 0::BIGINT AS disordered FROM customer, (VALUES {_FORMS}) v(form) GROUP BY 1")
def text_forms_keep_order(spark, d):
    """The integers of texts are in the order of the texts."""
    chars = "".join(chr(c) for c in range(32, 127))
    made = C.text_forms(_table(spark, d, "customer"), "c_name", chars, 32)
    by_text = materialize(with_rank(made.select("form", "text", "code", F.length("code").alias("digits")), "form", "text", name="a"), "by-text")
    both = with_rank(by_text, "form", "digits", "code", name="b")
    return both.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("disordered"))


@query(f"WITH {EV} SELECT count(*) AS n, 0::BIGINT AS uncovered, true AS within_share, true AS merged FROM ev")
def least_square_segments(spark, d):
    """Lines by least squares over all keys, merged while at most a twentieth of the keys is sent to a wrong page."""
    r = _ranked(spark, d)
    m = materialize(TU.least_square_segments(r, 64, 256), "lines")
    found = asof(r, m, "rank", "first_rank", ["last_rank"])
    covered = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("rank") <= F.col("last_rank"), F.lit(False))).alias("uncovered"))
    size = F.col("last_rank") - F.col("first_rank") + 1
    shares = m.agg(F.bool_and((size <= 64) | (F.col("page_errors") <= 0.05 * size)).alias("within_share"), (F.sum(size) == F.max("last_rank") + 1).alias("whole"), (F.max(size) > 64).alias("longer"))
    return covered.join(shares).select("n", "uncovered", "within_share", (F.col("whole") & F.col("longer")).alias("merged"))
