"""Language identification by compression: the language whose dictionary shortens a text most.

For each learned language, zstandard compresses the text with a raw-content dictionary of that
language's training text, both lower-cased; the smallest sum of bytes wins, ties go to the language with more
training rows, then the smaller name.  `accepted` is false where the margin over the second is
narrower than `margin`.  zstandard stores a block as it is if compressing it saves under a few bytes,
so every chunk goes before MARK, which ends all dictionaries too: a match of it pays for the block,
and then a single word of a short text counts.

The dictionaries are fitted on a bounded sample, whose bounds are parameters: the `languages` with
the most training rows; of each, `sample_docs` different passages of at most 512 characters, chosen
by hashes, so that neither copies nor short texts keep a language out; and of those, each cut to an
equal share, `dictionary_bytes` in all.  Every whole text is compressed, in chunks of `chunk` bytes
that bound a worker's memory.

Defined results: `und` and score 0 if the text is null or has no letter, or nothing was learned; a
language whose training texts are all empty is not learned; repeated rows get the same result; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, table

LETTER = regex.compile(r"\p{L}")
MARK = bytes(range(1, 33))


def dictionaries(train: DataFrame, sample_docs: int, dictionary_bytes: int, languages: int) -> list[tuple[str, bytes]]:
    """(language, raw content) of `train` (text, lang), the language with the most rows first.

    A passage is the middle of a text.  The passages of a language are dealt to `sample_docs` bins by
    a hash, and the one of the least hash in each stays: copies meet in one bin, tasks send at most
    that many rows a language, and a language of few texts keeps nearly all.
    """
    known = train.filter("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r.lang: r.n for r in counts}
    if not counts:
        return []
    learned = known.sparkSession.createDataFrame([(k,) for k in counts], "lang string")
    body = F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2 - 256).cast("int")), F.lit(512))
    # At most `languages` short rows.
    body = known.join(F.broadcast(learned), "lang").select("lang", body.alias("body")).filter("body <> ''")
    body = body.withColumn("h", F.xxhash64("body"))
    rows = body.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bin")).agg(F.min_by("body", "h").alias("body"), F.min("h").alias("h")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        texts.setdefault(r.lang, []).append(r.body)
    found = []
    for lang, passages in texts.items():
        share = max(64, dictionary_bytes // len(passages))
        content = "\n".join(p[:share] for p in passages).lower().encode()[-dictionary_bytes:]
        # zstandard takes no notice of a dictionary of under 8 bytes.
        found.append((lang, content * -(-64 // len(content)) if len(content) < 64 else content))
    return sorted(found, key=lambda x: (-counts[x[0]], x[0]))


def identify(
    docs: DataFrame,
    train: DataFrame,
    *,
    keep: tuple[Column, ...] = (),
    id_col="doc_id",
    text_col="text",
    sample_docs: int = 512,
    languages: int = 512,
    dictionary_bytes: int = 32 << 10,
    level: int = 6,
    chunk: int = 1 << 10,
    margin: float = 0.02,
) -> DataFrame:
    """doc_id, the columns `keep`, lang_pred, score (0 to 1) and accepted, for every row of docs."""
    learned = dictionaries(train, sample_docs, dictionary_bytes, languages)
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    held: dict = {}

    def compressors() -> list:
        if not held:
            held["c"] = []
            for lang, content in shared.value:
                d = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                how = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                held["c"].append((lang, how.compress))
        return held["c"]

    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not text or not LETTER.search(text) or not compressors():
                rows.append(("und", 0.0, False))
                continue
            raw = text.lower().encode()
            sizes = [(sum(len(f(raw[i : i + chunk] + MARK)) for i in range(0, len(raw), chunk)), k, lang) for k, (lang, f) in enumerate(compressors())]
            best, *others = sorted(sizes)
            lead = (others[0][0] - best[0]) / max(1, others[0][0]) if others else 1.0
            # A lead of a fifth or more is as sure as it gets; the score falls to a half at no lead.
            rows.append((best[2], 0.5 + min(0.5, 2.5 * lead), lead >= margin))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])

    judge.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    judged = F.pandas_udf(judge, "lang_pred string, score double, accepted boolean")
    out = docs.select(F.col(id_col).alias("doc_id"), *keep, judged(F.col(text_col)).alias("j"))
    return out.select("*", "j.*").drop("j")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs, docs.filter(~held_out), keep=(held_out.alias("held_out"),))
