import os

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankfold import catalogue, catalogue_more  # noqa: F401  the second adds to the first
from rankfold.operators import encodings, lookups, models, store
from rankfold.operators.ranking import asof, with_rank
from rankfold.plans import workload
from rankfold.sources import keys
from rankfold.streaming.upserts import stream_into

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        want = con.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("data", [[], [7], [5] * 2000, [0, (1 << 63) - 1], list(range(0, 5000, 3)) + [10**15]])
def test_lookups_at_the_edges(spark, data):
    table = spark.createDataFrame([(k,) for k in data], "key long")
    probes = sorted({*data[:50], -1, 1, 4, 6, (1 << 63) - 1})
    asked = spark.createDataFrame([(p,) for p in probes], "probe long")
    got = {r.probe: (r.lower, r.upper) for r in lookups.bounds(table, asked).collect()} if data else {}
    x = np.array(sorted(data), dtype=np.int64)
    for p, (low, up) in got.items():
        assert (low, up) == (np.searchsorted(x, p, "left"), np.searchsorted(x, p, "right"))
    if data:
        found = {r.probe: r["rank"] for r in models.model_lookup(table, asked, eps=8, per_page=16).collect()}
        for p in probes:
            assert found[p] == (int(np.searchsorted(x, p)) if p in data else None)


@pytest.mark.parametrize("how", [{}, {"page": 64}, {"spline": True}])
def test_segments_keep_their_error(spark, how):
    random = np.random.default_rng(42)
    k = np.unique(random.lognormal(0, 2, 20_000) * 1e6).astype(np.int64)
    k = np.unique(k)
    ranked = with_rank(spark.createDataFrame([(int(v),) for v in k], "key long"), "key")
    seg = models.segments(ranked, 32, **how).toPandas().sort_values("first_key")
    assert seg["max_err"].max() <= (33 if not how.get("page") else 32 + 64)
    assert seg["first_rank"].iloc[0] == 0 and seg["last_rank"].iloc[-1] == len(k) - 1
    assert (seg["first_rank"].to_numpy()[1:] == seg["last_rank"].to_numpy()[:-1] + 1).all()
    assert len(seg) > 5


def test_predecessors_of_one_hot_key(spark):
    """All rows share a key but two: the key's rows spread over ranges, and what is found does not change."""
    data = spark.createDataFrame([(5, v) for v in range(20_000)] + [(1, -1), (9, -9)], "key long, v long").repartition(8)
    asked = spark.createDataFrame([(p,) for p in [0, 1, 4, 5, 6, 9, None] + [5] * 3000], "probe long")
    got = {r.probe: r.v for r in asof(asked, data, "probe", "key", ["v"]).distinct().collect()}
    assert got == {0: None, 1: -1, 4: -1, 5: 19_999, 6: 19_999, 9: -9, None: None}
    none = data.limit(0)
    assert asof(asked, none, "probe", "key", ["v"]).filter("v is not null").count() == 0 and asof(asked.limit(0), data, "probe", "key", ["v"]).count() == 0


def test_strict_predecessor(spark):
    data = spark.createDataFrame([(k, k * 2) for k in range(0, 1000, 10)], "key long, v long")
    asked = spark.createDataFrame([(p,) for p in (0, 5, 10, 995)], "probe long")
    got = {r.probe: r.v for r in asof(asked, data, "probe", "key", ["v"], strict=True).collect()}
    assert got == {0: None, 5: 0, 10: 0, 995: 1980}


def test_delete_then_insert_again(spark):
    base = spark.createDataFrame([(1, 10, 0, False), (2, 20, 0, False)], "key long, value long, seq long, deleted boolean")
    s = store.Store(base, budget_rows=1)
    s = s.apply(base.select("key", "value", F.lit(1).cast("long").alias("seq"), F.lit(True).alias("deleted")))
    assert s.version == 1 and s.rows().count() == 0
    s = s.apply(spark.createDataFrame([(2, 7, 2, False)], base.schema))
    assert [(r.key, r.value) for r in s.rows().collect()] == [(2, 7)]


def test_streamed_operations(spark, tmp_path):
    base = spark.createDataFrame([(k, 0, 0, False) for k in range(10)], "key long, value long, seq long, deleted boolean")
    for i, part in enumerate(([(3, 30, 2, False), (4, 0, 1, True)], [(3, 29, 1, False), (11, 5, 3, False)])):
        spark.createDataFrame(part, base.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ops = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, held = stream_into(ops, store.Store(base), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r.key: r.value for r in held["store"].rows().collect()}
    assert got == {k: 0 for k in range(10) if k != 4} | {3: 30, 11: 5}


def test_key_file(spark, tmp_path):
    want = [5, 1, (1 << 64) - 1, 1 << 63]
    keys.write_keys(want, str(tmp_path / "k"))
    assert sorted(int(r.key) for r in keys.read_keys(spark, str(tmp_path / "k")).collect()) == sorted(want)


def test_encodings_of_random_blocks(spark):
    random = np.random.default_rng(1)
    x = [(int(v),) for v in random.integers(0, 1 << 40, 3000)]
    b = encodings.blocks(spark.createDataFrame(x, "key long"), 128)
    assert encodings.undo_deltas(encodings.deltas(b)).filter("decoded <> key").count() == 0
    lines = encodings.stored_line(encodings.line_fit(b))
    stored = encodings.line_residuals(b, lines).select("block_id", "idx", "residual")
    back = encodings.line_keys(stored, lines, "decoded").join(b, ["block_id", "idx"])
    assert back.count() == 3000 and back.filter("decoded <> key").count() == 0


def test_workloads_stay_in_range(spark):
    for df in (workload.zipf_ranks(spark, 2000, 100), workload.zipf_ranks(spark, 2000, 100, scrambled=True), workload.hotspot_ranks(spark, 2000, 100), workload.uniform_ranks(spark, 2000, 100)):
        lo, hi = df.agg(F.min("rank"), F.max("rank")).first()
        assert 0 <= lo and hi < 100
