"""The training-corpus pipeline: five stages from `documents` to a weighted mix.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame; all but the last return the columns of documents.  n_chars is kept in step with text.

1. quality rules: rows that the base rules or the learned decision list reject go.
2. SimHash near-dedup: texts whose fingerprints link, and which have 0.8 or more of their five-word shingles in
   common (Jaccard, compared exactly), are near copies; of each group of linked ones the row of the least doc_id stays.
3. substring dedup: words of repeated 20-word windows go from all but their first place; a row that
   loses all its words goes.
4. benchmark decontamination: rows that hold a benchmark window go.
5. mixing: rows of which the mix takes words stay, with the words taken and the places in the
   schedule where (slot, epoch, first word, words).

Nulls: a null text has no words, so the first stage rejects it; null ids and sources are kept as values of their own.
Equal texts and repeated rows leave one row in near-dedup.  Stages take empty tables, and extra columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankfold.llm import decontaminate, mixing, quality, simhash, substrings
from rankfold.llm.common import Scratch, table, unused


def packed(docs, *cols):
    """docs with the whole row in the column _row, so that its other names clash with none that a stage makes."""
    return docs.select(*cols, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(rows, docs, **new):
    """The columns of docs, some of them new."""
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark, docs, sf_dir):
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.judge_quality(packed(docs, "text"), rules).filter("kept"), docs)


def near_dedup(spark, docs, sf_dir):
    return simhash.near_dedup(docs)


def substring_dedup(spark, docs, sf_dir):
    out = substrings.remove_repeats(packed(docs, "doc_id", "text"), keep=["_row"])
    out = out.filter("n_words > n_removed or n_removed = 0")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs, **new)


def decontamination(spark, docs, sf_dir):
    out = decontaminate.judge_contamination(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return unpacked(out.filter("not contaminated"), docs)


def mix(spark, docs, sf_dir):
    seed = 17
    made = mixing.mix_sources(docs.select("doc_id", "text", "source"), seed=seed)
    places = F.sort_array(F.collect_list(F.struct("slot", "epoch", "start_word", "n_words"))).alias("places")
    places = made.pieces.groupBy("sid", "bucket", "rn").agg(places, F.sum("n_words").alias("taken"))
    # Rows come back by their key and, as repeated rows share one, their number among those; texts are shuffled once.
    copy = F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "source"))
    mixed = made.documents.withColumn("copy", copy).join(places, ["sid", "bucket", "rn"])
    mixed = Scratch(spark, "mixed").save(mixed.select("key", "copy", "size", "source_size", "target", "taken", "places"), "mixed")
    rows = packed(docs, mixing.row_key(seed, F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "source")
    rows = rows.withColumn("copy", copy).select("key", "copy", "_row")
    out = rows.join(mixed, ["key", "copy"])
    # Names of docs win; the stage's own get an underscore where they clash.
    ours = ("size", "source_size", "target", "taken", "places")
    return out.select("_row.*", *[F.col(c).alias(n) for c, n in zip(ours, unused(docs, *ours), strict=True)])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Learned rules, majorities of hashes and components are out of SQL's reach; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
