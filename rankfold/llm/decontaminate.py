"""Benchmark decontamination by winnowing, with DataFrame operations only.

A benchmark item of `window` words or more has every run of `window` words as a window, a shorter
one is a window itself.  Each text is reduced to fingerprints: the least `gram`-word hash of every
run of `window` words (short items: the hash of the whole), so that a shared window always shares
a fingerprint.  Documents that share one are candidates; only their windows are compared word for
word with the items' windows, and hits are extended to all the words that they cover.

Defined results: a null text or item has no words; items without words or id match nothing;
repeated items count once; repeated rows get the same result; empty tables give empty results or
no hits; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER_GAP, Scratch, lower_ascii, table

#: Bytes up to which a table of fingerprints, windows or candidates is broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), LETTER_GAP), "")


def _starts(size: Column, width: int) -> Column:
    """0 .. size - width, or nothing."""
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def _runs(size: Column, width: int) -> Column:
    return F.transform(_starts(size, width), lambda i: F.struct(i.alias("i"), F.lit(width).alias("n")))


def _grams(words: Column, width: int) -> Column:
    return F.transform(_starts(F.size(words), width), lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)]))


def _prints(df: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """df with `words` turned to `prints`: winnowed hashes, and all runs of the short lengths."""
    span = window - gram + 1
    df = df.withColumn("grams", _grams(F.col("words"), gram))
    least = F.transform(_starts(F.size("grams"), span), lambda i: F.least(*[F.get(F.col("grams"), i + k) for k in range(span)]))
    every = [least, *[_grams(F.col("words"), n) for n in short]]
    return df.withColumn("prints", F.array_distinct(F.concat(*every))).drop("grams")


def _bytes(df: DataFrame, size: Column) -> int:
    """Bytes of a table whose rows take `size` each, and 64 for the row itself."""
    return df.agg(F.sum(size + 64)).first()[0] or 0


def _sized(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def contaminated_words(
    docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = 10, gram: int = 5, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, text_hash, spans: sorted array of (start, n), item_ids: array) of documents with hits."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    tests = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).filter("item_id is not null and size(words) > 0")
    tests = scratch.save(tests, "tests")
    short = sorted(r[0] for r in tests.select(F.size("words")).distinct().filter(f"size(words) < {window}").collect())
    width = F.least(F.size("words"), F.lit(window))
    wins = tests.select("item_id", "words", width.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - width + 1)).alias("i"))
    wins = wins.select("item_id", "n", F.array_join(F.slice("words", F.col("i"), F.col("n")), " ").alias("win"))
    wins = scratch.save(wins.groupBy("n", "win").agg(F.collect_set("item_id").alias("item_ids")), "windows")
    # Items long enough give their winnowed hashes; a short one gives the hash of its whole.
    long = _prints(tests.filter(F.size("words") >= window), window, gram, []).select(F.explode_outer("prints").alias("print"))
    for n in short:
        long = long.unionByName(tests.filter(F.size("words") == n).select(F.explode_outer(_grams(F.col("words"), n)).alias("print")))
    prints = scratch.save(long.distinct(), "prints")
    n_wins = _bytes(wins, F.octet_length("win") + F.expr("aggregate(item_ids, 0L, (a, x) -> a + 16 + octet_length(cast(x as string)))"))
    n_prints = _bytes(prints, F.lit(8))

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    # An inner explode would make the optimizer filter by the arrays' sizes, with the whole computation
    # copied into the filter and run again for every element of it.
    seen = _prints(keyed, window, gram, short).select("doc_id", "text_hash", F.explode_outer("prints").alias("print"))
    hit = seen.join(_sized(prints, n_prints), "print", "left_semi").select("doc_id", "text_hash").distinct()
    hit = scratch.save(hit, "candidates")
    n_hit = _bytes(hit, 24 + F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    # Rows with equal id and text find the same windows; the sets below take them once.
    found = keyed.join(_sized(hit.toDF("d", "t"), n_hit), same, "left_semi")
    runs = [_runs(F.size("words"), n) for n in [*short, window]]
    # Windows are cut before they become rows, so that no row carries the words of its whole text.
    windows = F.transform(F.concat(*runs), lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), F.array_join(F.slice("words", r["i"] + 1, r["n"]), " ").alias("win")))
    found = found.select("doc_id", "text_hash", F.explode_outer(windows).alias("r")).filter("r is not null").select("doc_id", "text_hash", "r.*")
    found = found.join(_sized(wins, n_wins), ["n", "win"])
    found = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("i", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    return scratch.save(found, "found")


def covered(spans: Column) -> Column:
    """Words that sorted spans (i, n) cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        stop = s["i"] + s["n"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(stop - F.greatest(acc["end"], s["i"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def judge_contamination(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", keep=(), **how) -> DataFrame:
    """One row per document: doc_id, the columns `keep`, n_words, n_hit, n_items, item_ids, spans, contaminated."""
    found = contaminated_words(docs, items, id_col=id_col, text_col=text_col, **how)
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "spans", "item_ids", covered(F.col("spans")).alias("hit"))
    spaced = F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" ")), LETTER_GAP, " ")
    n_words = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.xxhash64(F.col(text_col)).alias("_h"), n_words.cast("long").alias("n_words"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)), lambda x: x.cast("string")))
    return rows.select(
        "doc_id", *keep, "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "spans",
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = judge_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM b WHERE len(ws) > 0),
bt AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM bw),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bt) WHERE len(ws) >= n),
dt AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS t FROM dw),
hits AS (SELECT doc_id, s, n, item_id FROM dt JOIN bt USING (n, t)),
wordsets AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM hits) GROUP BY doc_id),
itemsets AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wordsets USING (doc_id) LEFT JOIN itemsets USING (doc_id)
"""
