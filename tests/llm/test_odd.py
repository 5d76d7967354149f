"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from test_llm import LONG, ODD

import corpus_pipeline
from rankfold.llm import chat, decontaminate, language, licenses, mixing, quality, simhash, substrings, tokencount, urlrules
from rankfold.llm.common import unused

#: Names that operators and stages use inside.
CLASHES = "n_words kept spans size places taken stats ratios base_failed key doc rk fp p0 id root text_hash words norm row _row _text _key _at _r k d s s2 n sid bucket rn label node slot block quota".split()
ITEMS = [(1, "Sit Amet lorem"), (2, None), (3, "absent words here"), (1, "sit amet lorem"), (None, "dolor")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"clash {c}"))
    return df


OPERATORS = {
    "mix": lambda spark, df: mixing.taken_words(mixing.mix_sources(df)),
    "decontaminate": lambda spark, df: decontaminate.judge_contamination(df, spark.createDataFrame(ITEMS, "item_id long, text string")),
    "language": lambda spark, df: language.identify(df, df),
    "substrings": lambda spark, df: substrings.remove_repeats(df),
    "licenses": lambda spark, df: licenses.scan_licenses(df),
    "fingerprints": lambda spark, df: simhash.fingerprints(df),
    "tokens": lambda spark, df: tokencount.count_tokens(df),
    "quality": lambda spark, df: quality.judge_quality(df.select("doc_id", "text"), quality.DecisionList(())),
    "urls": lambda spark, df: urlrules.judge_urls(df, id_col="doc_id", url_col="text"),
    "chats": lambda spark, df: chat.format_chats(df, conv_col="rowid", turn_col="doc_id", role_col="source"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_and_empty_tables(spark, docs, name):
    docs = docs.withColumn("rowid", F.monotonically_increasing_id())
    got = OPERATORS[name](spark, docs)
    assert got.count() == len(ODD) and got.columns == OPERATORS[name](spark, docs.limit(0)).columns
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["urls", "substrings", "quality", "tokens", "mix", "decontaminate", "language"])
def test_operators_take_very_long_texts(spark, name):
    long = "http://a.example.com/en/7" + "/x" * 100 + " " + LONG * 400
    df = spark.createDataFrame([(1, long, "a"), (2, "short", "a")], "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    assert OPERATORS[name](spark, df).count() == 2


#: Ids that each stage leaves of ODD, whose only labels reject nothing beyond the base rules.
STAGES = {"quality_rules": [], "near_dedup": [None, 1, 3, 5, 6], "substring_dedup": [None, 1, 1, 2, 3, 5, 6, 6], "decontamination": [None, 1, 1, 2, 3, 4, 4, 5, 6, 6], "mix": [None, 3, 4, 4, 5, 6]}


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_odd_and_empty_tables(spark, docs, name, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").filter("item_id > 2").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(3, 1, 0), (None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i)) == STAGES[name]
    assert out.columns[: len(docs.columns)] == docs.columns and (name == "mix" or len(out.columns) == len(docs.columns))
    assert all(r[c] == f"clash {c}" for r in rows for c in CLASHES)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns


def test_unused_names(spark):
    df = spark.createDataFrame([], "k int, _K int, d int")
    assert unused(df, "k", "d", "k") == ["__k", "_d", "___k"]
