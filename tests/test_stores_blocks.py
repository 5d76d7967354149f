import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold import catalogue, catalogue_more  # noqa: F401  the second adds its queries to the first
from rankfold.functions.keys import morton_axis, morton_code
from rankfold.operators import codecs, hulls, levels, models, packed, spatial, store, tiers, tuning
from rankfold.operators.adaptive import Leaves
from rankfold.operators.ranking import with_rank
from rankfold.plans import generators
from rankfold.session import materialize

CHANGE = "key long, value long, seq long, deleted boolean"
CODECS = [m if c == "pack" else f"{m}+{c}" for m in packed.MODELS for c in packed.CODERS if m != "copy" or c == "pack"]


def row_of(keys, codec):
    return dict(zip(packed.NAMES, (0, 0, len(keys), codec, int(keys.min()), int(keys.max()), *packed.encode_block(keys, codec)), strict=True))


@pytest.mark.parametrize("codec", CODECS)
def test_every_codec_gives_back_every_key(codec):
    random = np.random.default_rng(0)
    for t in range(60):
        n = int(random.integers(1, 300))
        keys = np.sort(random.integers(0, 1 << int(random.integers(1, 50)), n)).astype(np.int64) - int(random.integers(0, 1 << 40))
        if t % 3 == 0:
            random.shuffle(keys)
        r = row_of(keys, codec)
        a = int(random.integers(0, n))
        b = int(random.integers(a + 1, n + 1))
        assert (packed.keys_of(r) == keys).all() and (packed.keys_of(r, a, b) == keys[a:b]).all()
        if t % 3:
            for p in (int(keys[a]) - 1, int(keys[a]), int(keys[-1]), int(keys[0]) - 5):
                assert packed.first_above(r, p) == np.searchsorted(keys, p, "right")


def test_bit_packing_and_entropy_coding():
    random = np.random.default_rng(1)
    for width in (0, 1, 7, 8, 13, 33, 63, 64):
        x = random.integers(0, 1 << min(width, 63), 77).astype(np.uint64) if width else np.zeros(77, np.uint64)
        data = packed.pack(x, width)
        assert len(data) == -(-77 * width // 8) and (packed.unpack(data, width, 0, 77) == x).all() and (packed.unpack(data, width, 5, 40) == x[5:40]).all()
    for raw in (b"", b"a", b"a" * 5000, bytes(range(256)) * 3, bytes(random.choice([1, 2, 200], 4000, p=[0.9, 0.09, 0.01]).astype(np.uint8))):
        assert packed.unrans(packed.rans(raw)) == raw
    skewed = bytes(random.choice([1, 2, 200], 4000, p=[0.9, 0.09, 0.01]).astype(np.uint8))
    assert len(packed.rans(skewed)) < 4000 * 0.6 / 8 + 60  # the entropy is 0.52 bits a byte


def test_minimax_line_has_the_least_error():
    random = np.random.default_rng(2)
    for _ in range(40):
        y = np.cumsum(random.integers(0, 50, int(random.integers(3, 60)))).astype(float)
        x = np.arange(len(y), dtype=float)
        width = lambda s: np.ptp(y - s * x)
        # An optimal slope is that of two of the points.
        best = min(width((y[j] - y[i]) / (j - i)) for i, j in itertools.combinations(range(len(y)), 2))
        assert width(packed.minimax_slope(y)) <= best + 1e-6
        keys = np.cumsum(random.integers(1, 90, len(y))).astype(float)
        slopes = [(j - i) / (keys[j] - keys[i]) for i, j in itertools.combinations(range(len(y)), 2)]
        off = lambda s: np.ptp(x - s * keys)
        assert off(tuning.line_slope(keys - keys[0], x)) <= min(map(off, slopes)) + 1e-6


def test_encoded_queries_at_the_edges(spark):
    arrays = spark.createDataFrame([(0, 0, [5]), (1, 1, [7, 7, 7]), (2, 4, [8, 1 << 40])], "block_id long, first_rank long, keys array<long>")
    for codec in ("line", "for", "delta", "quad+bytes"):
        e = packed.encode(arrays, codec)
        assert [(r.rank, r.key) for r in packed.decode(e).orderBy("rank").collect()] == list(enumerate([5, 7, 7, 7, 8, 1 << 40]))
        assert [r.rank for r in packed.above(e, 7).orderBy("rank").collect()] == [4, 5] and packed.above(e, 1 << 40).count() == 0
        probes = spark.createDataFrame([(p,) for p in (0, 5, 6, 7, 8, 1 << 41)], "probe long")
        assert {r.probe: r.upper for r in packed.upper_bound(e, probes).collect()} == {0: 0, 5: 1, 6: 1, 7: 4, 8: 5, 1 << 41: 6}
        assert packed.sums(e).agg(F.sum("total")).first()[0] == 5 + 21 + 8 + (1 << 40)
    empty = packed.encode(arrays.limit(0))
    assert packed.decode(empty).count() == 0 and packed.stored_bytes(empty).count() == 0


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_z_ranges_hold_the_box(spark, dims):
    random, width = np.random.default_rng(dims), 4 if dims < 4 else 3

    def code(c):
        return sum((v >> i & 1) << i * dims + k for k, v in enumerate(c) for i in range(width))

    for _ in range(25):
        low = [int(random.integers(1 << width)) for _ in range(dims)]
        high = [int(random.integers(v, 1 << width)) for v in low]
        for most in (4, 32, 1000):
            ranges = spatial.z_ranges(low, high, width, most)
            assert len(ranges) <= most and all(b < c for (_, b), (c, _) in itertools.pairwise(ranges))
            for c in itertools.product(range(1 << width), repeat=dims):
                inside = all(lo <= v <= hi for v, lo, hi in zip(c, low, high))
                held = any(a <= code(c) <= b for a, b in ranges)
                assert held or not inside
                assert most < 1000 or held == inside
    axes = [F.col(f"a{i}") for i in range(dims)]
    rows = [tuple(int(v) for v in random.integers(0, 1 << 15, dims)) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"a{i} long" for i in range(dims)))
    z = df.withColumn("z", morton_code(axes, 15))
    assert z.select(*[(morton_axis(F.col("z"), i, dims, 15) == axes[i]) for i in range(dims)]).distinct().count() == 1


@pytest.mark.parametrize("spline", [False, True])
def test_granule_lookup_broadcasts_no_windows(spark, spline):
    random = np.random.default_rng(4)
    keys = np.sort(np.concatenate([np.cumsum(random.integers(1, 1000, 6000)), [77_777] * 3000])).astype(np.int64)
    r = materialize(with_rank(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key"), "ranked")
    model = materialize(models.segments(tuning.granule_ends(r, 8), 40, spline=spline), "model")  # windows of up to 83 granules
    asked = sorted({int(k) + d for k in keys[::5] for d in (0, 1)} | {77_777, int(keys[0]) - 5, int(keys[-1]) + 5})
    found = tuning.granule_lookup(r, spark.createDataFrame([(k,) for k in asked], "probe long"), model, 8)
    first = {int(k): i for i, k in reversed(list(enumerate(keys)))}
    assert {x.probe: x["rank"] for x in found.collect()} == {k: first.get(k) for k in asked}
    # The probes' windows are many at size: their join with the granules is merged.
    joins = re.findall(r"(\w+Join) \[probe#\w+, (?:page_id|band)#", found._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


@pytest.mark.parametrize("spline", [True, False])
def test_granule_lookup_broadcasts_nothing_by_probe(spark, spline):
    keys = np.cumsum(np.random.default_rng(6).integers(1, 1000, 3000)).astype(np.int64)
    r = materialize(with_rank(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key"), "ranked")
    model = materialize(models.segments(tuning.granule_ends(r, 8), 40, spline=spline), "model")
    asked = sorted({int(k) + d for k in keys[::5] for d in (0, 1)} | {int(keys[0]) - 5, int(keys[-1]) + 5})
    found = tuning.granule_lookup(r, spark.createDataFrame([*[(k,) for k in asked], (None,)], "probe long"), model, 8)
    first = {int(k): i for i, k in enumerate(keys)}
    assert {x.probe: x["rank"] for x in found.collect()} == {k: first.get(k) for k in [*asked, None]}
    # Neither windows nor the ranks found in them go through the driver, also where they are few.
    joins = re.findall(r"(\w+Join) \[probe#", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert len(joins) == 2 and set(joins) == {"SortMergeJoin"}


def test_morton_round_trip_of_large_numbers(spark, tmp_path):
    ids = [0, (1 << 20) - 1, 1 << 20, (1 << 20) + 7, (1 << 21) + 3, 1 << 40, (1 << 63) - 1, -1, -(1 << 63)]
    prices = [900.0, 0.0, 20_000_000.0, 3e12, 1.0, 2.0, 999.99, 0.01, 5.0]
    part = spark.createDataFrame([(i, k + 1, p) for k, (i, p) in enumerate(zip(ids, prices, strict=True))], "p_partkey long, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["morton_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, k + 1, round(p * 100) // 100, i) for k, (i, p) in enumerate(zip(ids, prices, strict=True)))


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_morton_words_keep_order_and_numbers(spark, dims):
    from rankfold.functions.keys import morton_words, morton_words_axis

    random = np.random.default_rng(dims)
    rows = [tuple(int(v) >> int(random.integers(0, 60)) for v in random.integers(0, (1 << 63) - 1, dims)) for _ in range(200)]
    axes = [F.col(f"a{i}") for i in range(dims)]
    df = spark.createDataFrame(rows + [tuple(-v - 1 for v in r) for r in rows], ", ".join(f"a{i} long" for i in range(dims)))
    z = df.withColumn("z", morton_words(axes))
    held = z.select(*axes, "z", F.array(*[morton_words_axis(F.col("z"), i, dims) for i in range(dims)]).alias("back")).collect()
    assert all(list(r[:dims]) == r["back"] for r in held)
    code = lambda r: sum((v >> i & 1) << i * dims + k for k, v in enumerate(r) for i in range(64))
    assert sorted(held, key=lambda r: r["z"]) == sorted(held, key=lambda r: code(r[:dims]))


def test_box_reads_few_files(spark):
    n = 64
    points = spark.range(n * n).select("id", (F.col("id") % n).alias("x"), F.expr(f"id div {n}").alias("y"))
    stored = spatial.z_ordered(points, width=6, files=16)
    found = spatial.box(stored, [3, 3], [9, 9], width=6)
    assert found.count() == 49
    assert "GreaterThanOrEqual(z," in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert found.select(F.input_file_name()).distinct().count() <= 4


def test_nearest_equals_brute_force(spark):
    random = np.random.default_rng(9)
    xy = np.concatenate([random.integers(0, 1000, (300, 2)), random.integers(400, 410, (100, 2)), [[5, 5]] * 20])
    points = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "id long, x long, y long")
    asked = [(0, 404, 404), (1, 5, 5), (2, 5000, 5000), (3, 0, 999), (4, 500, 20)]
    got = {(r.query, r.pos): (r.id, r.dist) for r in spatial.nearest(points, spark.createDataFrame(asked, "query long, x long, y long"), 7).collect()}
    for q, x, y in asked:
        d = ((xy - [x, y]) ** 2).sum(1)
        order = np.lexsort((np.arange(len(d)), d))[:7]
        assert [got[q, k + 1] for k in range(7)] == [(int(i), int(d[i])) for i in order]
    few = spatial.nearest(points.limit(3), spark.createDataFrame(asked[:1], "query long, x long, y long"), 7)
    assert few.count() == 3


def test_levels_follow_a_dictionary(spark):
    random, want, store, seq = np.random.default_rng(6), {}, levels.Levels(spark, buffer_rows=20, base=3), 0
    for _ in range(7):
        batch = []
        for _ in range(40):
            seq += 1
            key, gone = int(random.integers(0, 60)), bool(random.random() < 0.3)
            batch.append((key, seq * 10, seq, gone))
            if gone:
                want.pop(key, None)
            else:
                want[key] = seq * 10
        old = store
        store = store.insert(spark.createDataFrame(batch, CHANGE))
    assert {r.key: r.value for r in store.rows().collect()} == want and store.size() == len(want)
    assert all(x.n <= store.capacity(i) for i, x in enumerate(store.levels) if x) and store.merges > 0
    # Tombstones do not outlive the last level, and the version before goes on as it was.
    last = [x for x in store.levels if x][-1]
    assert len([x for x in store.levels if x]) == 1 or last.rows.filter("deleted").count() == 0
    assert old.version == store.version - 1 and old.size() >= 0
    probes = spark.createDataFrame([(p,) for p in range(-1, 63)], "probe long")
    assert {r.probe: r.value for r in store.find(probes).collect()} == {p: want.get(p) for p in range(-1, 63)}
    ceiling = {p: min((k for k in want if k >= p), default=None) for p in range(-1, 63)}
    assert {r.probe: r.key for r in store.lower_bound(probes).collect()} == ceiling
    assert [(r.key, r.value) for r in store.between(10, 30).collect()] == sorted((k, v) for k, v in want.items() if 10 <= k <= 30)
    empty = levels.Levels(spark)
    assert empty.size() == 0 and empty.find(probes).filter("value is not null").count() == 0 and empty.between(0, 9).count() == 0


def test_tiers_keep_every_row_once(spark):
    rows = [(k, k * 2, k * 7 % 100) for k in range(100)]
    t = tiers.Tiered(spark.createDataFrame(rows, "key long, value long, last_access long"), capacity=30, per_page=16).evict()
    t = t.append(spark.createDataFrame([(3, 0, 500), (200, 1, 501)], "key long, value long, last_access long"))
    got = t.between(0, 1000).collect()
    assert len(got) == 102 and {(r.key, r.tier) for r in got if r.key in (200,)} == {(200, "memory")} and sum(r.tier == "late" for r in got) == 1
    hot = {k for k, _, a in sorted(rows, key=lambda r: (-r[2], r[0]))[:30]}
    assert {r.key for r in got if r.tier == "memory"} - {200} == hot
    again = t.evict().between(0, 1000).collect()
    assert len(again) == 102 and sum(r.tier == "memory" for r in again) == 30 and all((r.page_id is not None) == (r.tier == "disk") for r in again)


def test_budgets_and_grids(spark):
    counts = [(e, 2000 * e**-1.2) for e in (4, 16, 64, 256)]
    a, b = tuning.power_law(counts)
    assert abs(a - 2000) < 1e-6 and abs(b + 1.2) < 1e-9
    eps = tuning.error_for_space(a, b, 3000)
    assert abs(a * eps**b * 16 - 3000) < 1e-3 and tuning.error_for_time(4, 256) == 383
    assert tuning.tree_levels(100_000, 256, 0.7, 256) == [559, 3, 1] and tuning.tree_levels(1, 256, 0.7, 256) == [1]
    r = with_rank(spark.range(1000).select((F.col("id") * F.col("id")).alias("key")), "key")
    got = {x["size"]: x.n_bytes for x in tuning.reference_sizes(r, [64, 128]).collect()}
    for size in (64, 128):
        want = 0
        for i in range(0, 1000, size):
            n = min(size, 1000 - i)
            want += (n * ((i + n - 1) ** 2 - i * i).bit_length() + 7) // 8 + 9
        assert got[size] == want


def test_generated_distributions(spark):
    n = 20_000
    x = np.array([r.value for r in generators.normal(spark, n).select("value").collect()])
    assert abs(x.mean() - 1e6) < 3e3 and abs(x.std() - 1e5) < 3e3
    gaps = np.diff(sorted(r.value for r in generators.arrivals(spark, n).select("value").collect()))
    assert abs(gaps.mean() - 1000) < 40 and abs(gaps.std() - 1000) < 60
    b = np.array([r.key for r in generators.binomial_keys(spark, n).collect()])
    g = np.array([r.key for r in generators.geometric_keys(spark, n).collect()])
    assert abs(b.mean() - 16) < 0.2 and abs(g.mean() - 99) < 5


def test_leaves_follow_a_dictionary(spark):
    random, want = np.random.default_rng(12), {}
    leaves = Leaves.load(spark.createDataFrame([], "key long, value long"), capacity=16)
    for k in range(5):
        # The last batches all go to one place.
        batch = [(int(v), k * 1000 + i) for i, v in enumerate(random.integers(0, 400, 60) if k < 3 else range(200 + 50 * k, 290 + 50 * k))]
        leaves = leaves.insert(spark.createDataFrame([*batch, (None, 0)], "key long, value long"))
        for key in {b[0] for b in batch}:
            want[key] = max(v for b, v in batch if b == key)
        if k == 2:
            leaves = leaves.erase(100, 150)
            want = {a: v for a, v in want.items() if not 100 <= a < 150}
    assert {r.key: r.value for r in leaves.rows.collect()} == want and leaves.splits > 0
    held = sorted((r.leaf, r.lo, r.hi, r.n) for r in leaves.leaves().collect())
    assert all(n <= 16 for *_, n in held) and all(a[2] < b[1] for a, b in itertools.pairwise(held))
    probes = spark.createDataFrame([(p,) for p in range(-3, 500, 3)], "probe long")
    assert {r.probe: r.value for r in leaves.find(probes).collect()} == {p: want.get(p) for p in range(-3, 500, 3)}


def test_ascending_numbers_in_two_parts():
    random = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        for top in (1, 1000, 1 << 40):
            x = np.sort(random.integers(0, top, n)).astype(np.uint64)
            low, packed_, high = packed.elias_fano(x)
            assert (packed.from_elias_fano(low, packed_, high, n) == x).all()
            assert (packed.from_elias_fano(low, packed_, high, n, n // 3, n // 2 + 1) == x[n // 3 : n // 2 + 1]).all()
            assert 8 * (len(packed_) + len(high)) <= n * (max(0, int(top).bit_length() - n.bit_length()) + 5) + 32


@pytest.mark.parametrize(("fix", "slide"), [(0, 1), (1, 1), (2, 3)])
def test_slack_separators_find_every_key(spark, fix, slide):
    keys = np.unique(np.random.default_rng(42).lognormal(0, 2, 2000) * 1e6).astype(np.int64)
    r = with_rank(spark.createDataFrame([(int(v),) for v in np.unique(keys)], "key long"), "key").persist()
    probes = r.select(F.col("key").alias("probe")).union(r.select(F.col("key") + 1))
    got = {x.probe: x["rank"] for x in hulls.slack_lookup(r, probes, *hulls.slack_separators(r, 16, fix, slide), 16, fix, slide).collect()}
    want = {x.key: x["rank"] for x in r.collect()}
    assert got == {p: want.get(p) for k in want for p in (k, k + 1)}


def test_text_forms_and_budget():
    random = np.random.default_rng(5)
    texts = sorted({"".join(random.choice(list("abcxyz "), random.integers(0, 9))) for _ in range(200)})
    ascii_, shifted = [codecs.ascii_to_integer(t, 8) for t in texts], [codecs.shifted_to_integer(t, " ", "z", 8) for t in texts]
    assert ascii_ == sorted(ascii_) and shifted == sorted(shifted)
    assert [codecs.integer_to_ascii(n, 8) for n in ascii_] == texts == [codecs.integer_to_shifted(n, " ", "z", 8) for n in shifted]
    assert store.budget_rows(1000, 200) == 50
    with pytest.raises(ValueError):
        store.budget_rows(10, 10)
