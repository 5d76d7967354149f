from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import codecs, hulls, models
from rankfold.operators.ranking import with_rank
from rankfold.plans import workload


def ranked_keys(spark, keys):
    return with_rank(spark.createDataFrame([(int(v),) for v in keys], "key long"), "key")


def skewed(n=8000):
    return np.unique(np.random.default_rng(42).lognormal(0, 2, n) * 1e6).astype(np.int64)


def test_no_line_reaches_one_point_more():
    random = np.random.default_rng(3)
    for _ in range(30):
        x = np.cumsum(random.integers(1, 100, 60)).astype(float)
        x -= x[0]
        y = np.arange(60.0)
        n, (lo, hi) = hulls.longest(x, y - 2, y + 2)
        assert lo <= hi
        for a in (lo, hi):
            assert hulls._gap(x[:n], y[:n] - 2, y[:n] + 2, a)[0] <= 1e-6
        if n < 60:
            # By brute force: the limits of slopes from all pairs leave none for the first n + 1 points.
            m = n + 1
            d = x[:m, None] - x[None, :m]
            i, j = np.where(d > 0)
            least = ((y[i] - 2 - (y[j] + 2)) / d[i, j]).max()
            most = ((y[i] + 2 - (y[j] - 2)) / d[i, j]).min()
            assert least > most - 1e-9


@pytest.mark.parametrize("page", [0, 64])
def test_hull_segments_keep_their_error_and_are_fewer(spark, page):
    r = ranked_keys(spark, np.unique(skewed())).persist()
    seg = hulls.hull_segments(r, 16, page)
    assert seg.agg(F.max("max_err")).first()[0] <= 16 + 1 + page
    x = seg.toPandas().sort_values("first_key")
    assert (x["first_rank"].to_numpy()[1:] == x["last_rank"].to_numpy()[:-1] + 1).all()
    assert len(x) <= models.segments(r, 16, page).count()
    merged = hulls.refit(r, hulls.merge_slopes(seg), 16, page).persist()
    assert merged.count() == len(x) and merged.agg(F.max("max_err")).first()[0] <= 16 + 2 + page


def test_segments_of_like_density_share_slopes(spark):
    keys = np.cumsum(np.random.default_rng(8).integers(1, 2000, 20_000))
    seg = hulls.hull_segments(ranked_keys(spark, keys), 8).persist()
    n = hulls.merge_slopes(seg).select("slope").distinct().count()
    assert 1 < n < seg.count()


@pytest.mark.parametrize("data", [[7], [5] * 300, [0, (1 << 62)], list(range(0, 900, 3)) * 2])
def test_compressed_models_at_the_edges(spark, data):
    r = ranked_keys(spark, data).persist()
    model = hulls.refit(r, hulls.merge_slopes(hulls.hull_segments(r, 4)), 4).persist()
    lines, rows = hulls.compress(model, 8)
    assert set(rows.columns) == {"block_id", "idx", "residual", "slope_id", "step", "correction", "covers"}
    back = hulls.decompress(lines, rows, hulls.slope_table(model))
    cols = ["first_key", "slope", "intercept", "first_rank", "last_rank"]
    assert back.select(cols).exceptAll(model.select(cols)).count() == 0 and back.count() == model.count()
    assert back.join(model.select("first_key", F.col("max_err").alias("own")), "first_key").filter("max_err < own").count() == 0
    probes = sorted({*data[:40], -1, 1, (1 << 62) + 1})
    asked = spark.createDataFrame([(p,) for p in probes], "probe long")
    x = np.sort(np.array(data, np.int64))
    want = {p: int(np.searchsorted(x, p)) if p in data else None for p in probes}
    for m, buckets in ((back, 0), (model, 16)):
        assert {a.probe: a["rank"] for a in hulls.find_ranks(r, asked, m, 16, buckets).collect()} == want


def test_separators_lie_between_pages(spark):
    r = ranked_keys(spark, np.unique(skewed(3000))).persist()
    seps = hulls.page_values(*hulls.separators(r, 32), "separator").collect()
    x = {a.page_id: (a.lo, a.hi) for a in r.groupBy(F.expr("rank div 32").alias("page_id")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
    for s in seps:
        assert s.separator <= x[s.page_id][0] and (s.page_id == 0 or s.separator > x[s.page_id - 1][1])


@pytest.mark.parametrize("kind", ["line", "delta"])
def test_best_pieces_are_cheapest(spark, kind):
    random = np.random.default_rng(5)
    y = np.cumsum(np.concatenate([random.integers(0, 4, 200), random.integers(0, 4000, 100), random.integers(7, 9, 200)]))
    cost = {}
    for name, cut in codecs.CUTS.items():
        starts = cut(y, kind, 16)
        cost[name] = sum(codecs._cost(y[a:b], kind) for a, b in pairwise([*starts, len(y)]))
        for a, b in pairwise([*starts, len(y)]):
            base, slope, width, codes = codecs.encode_piece(y[a:b], kind)
            assert (codecs.decode_piece(base, slope, codes, kind) == y[a:b]).all()
            assert int(np.abs(codes).max()).bit_length() <= width
    assert cost["best"] <= min(cost.values()) and cost["best"] < codecs._cost(y, kind)


@pytest.mark.parametrize("texts", [["", "a", "ab", "b"], ["same"] * 3, ["é", "日本", "日本語"], [""]])
def test_strings_as_integers(spark, texts):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(sorted(texts))], "block_id long, idx long, t string")
    got = codecs.string_at(codecs.string_blocks(df, "t"), df.select("block_id", "idx")).collect()
    assert sorted((r.idx, r.text) for r in got) == list(enumerate(sorted(texts)))
    chars = codecs.alphabet(texts)
    codes = [codecs.to_integer(t, chars, max(map(len, texts))) for t in sorted(texts)]
    assert codes == sorted(codes)


def test_symbols_shrink_and_come_back():
    texts = [f"https://example.com/en/page/{i}?q={i * 7}".encode() for i in range(200)] + [b"", bytes(range(256))]
    table = codecs.symbols(texts)
    coded = [codecs.encode_symbols(t, table) for t in texts]
    assert [codecs.decode_symbols(c, table) for c in coded] == texts and len(table) <= 255
    assert sum(map(len, coded[:200])) < 0.5 * sum(map(len, texts[:200]))


def test_prefix_codes_are_within_a_bit_of_entropy(spark):
    random = np.random.default_rng(9)
    v = random.zipf(1.6, 4000) % 50
    df = spark.createDataFrame([(0, int(x)) for x in v], "block_id long, v long")
    bits = codecs.prefix_code_bits(df, "v").first().bits
    p = np.unique(v, return_counts=True)[1] / len(v)
    h = -(p * np.log2(p)).sum() * len(v)
    assert h <= bits <= h + len(v)
    assert codecs.code_lengths({3: 5}) == {3: 1}


def test_hard_keys_ascend_and_are_harder(spark):
    n = {}
    for local, broad in ((1, 1), (6, 1)):
        r = with_rank(workload.hard_keys(spark, 8000, local, broad).select("key"), "key").persist()
        assert r.select("key").distinct().count() == 8000
        n[local] = hulls.hull_segments(r, 8).count()
    assert n[6] > 2 * n[1]
