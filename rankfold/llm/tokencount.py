"""Token counts of byte-level BPE by a map-side two-tier lookup; no pre-token is shuffled.

Texts are cut into pre-tokens as the tokenizer does.  A broadcast hash table gives the lengths of
frequent pre-tokens; a miss is encoded by the library and kept in the worker's own cache, if it has
at most LONGEST characters.  A text with characters on which libraries' tables of Unicode may differ
is cut before words after a single space, where no pre-token can reach over, and only the pieces
that hold such a character go to the library.  The table is fitted on the words of a bounded sample (at most about `sample_docs` documents) and holds
at most `table_size` entries; it only saves work: counts are those of the library either way.

Defined results: a null text is empty and has 0 tokens; the strings of special tokens inside a
text count as the library's default has it; repeated rows count alike; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import spread, table

#: Entries that a worker's cache of misses holds before it starts anew.
CACHE = 1 << 18
#: Characters of a pre-token from which on it is not kept.
LONGEST = 64
#: Before a space and an ASCII letter, after anything but white space: pre-tokens end and begin there.
CUT = re.compile(r"(?<=\S)(?= [A-Za-z])")


def _exotic() -> str:
    """A class of the characters whose Unicode category or white space may differ between libraries' tables.

    All of the planes above the first, what was assigned after Unicode 3.2, and odd white space.
    """
    old, runs, start = unicodedata.ucd_3_2_0.category, [], None
    for c in range(0x10000):
        odd = 0xD800 <= c < 0xE000 or old(chr(c)) != unicodedata.category(chr(c)) or old(chr(c)) == "Cn" or 0x1C <= c <= 0x1F or c in (0x85, 0x180E)
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            runs.append((start, c - 1))
            start = None
    runs.append((start if start is not None else 0x10000, 0x10FFFF))
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


class Counting(dict):
    """Pre-token -> number of tokens, over a shared table of frequent ones."""

    def __init__(self, path: str, frequent: dict):
        super().__init__()
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.exotic = re.compile(_exotic()).search  # re looks a character up in a table, regex tries the ranges in turn

    def __missing__(self, piece: str) -> int:
        n = self.frequent.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.exotic(text):
            n, plain = 0, []
            for piece in CUT.split(text):
                if self.exotic(piece):
                    n += len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
                else:
                    plain.append(piece)
            return n + self.count("".join(plain)) if plain else n
        n, get = 0, self.__getitem__
        if self.cut and self.cut.search(text):
            n, parts = len(self.cut.findall(text)), self.cut.split(text)
        else:
            parts = (text,)
        for part in parts:
            n += sum(map(get, self.pieces(part)))
        return n


def frequent_lengths(docs: DataFrame, path: str, text_col: str, sample_docs: int, table_size: int) -> dict:
    """Lengths of the most frequent pre-tokens of about `sample_docs` rows, drawn at random, as any sample will do.

    Each partition sends its own most frequent ones, a share of the table; at most twice the table
    reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.count()
    if not rows:
        return {}
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_docs / rows), seed=1).filter("text is not null")
    each = max(64, 2 * table_size // max(1, sample.rdd.getNumPartitions()))

    def counted(batches):
        seen, pieces = Counter(), regex.compile(public_tokenizers.PATTERN).findall
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pieces(text))
        top = seen.most_common(each)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    counts = sample.mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r.piece for r in counts.orderBy(F.desc("n"), "piece").limit(table_size).collect()]
    encoded = Tokenizer.from_file(path).encode_batch(top, add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(top, encoded)}


def count_tokens(
    docs: DataFrame, *, tokenizer: str | None = None, id_col="doc_id", text_col="text", limit: int = 512, sample_docs: int = 2000, table_size: int = 50_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; `tokenizer` is a path that executors can read too."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, sample_docs, table_size))
    held: dict = {}

    def lengths(texts: pd.Series) -> pd.Series:
        if not held:
            held["c"] = Counting(path, shared.value)
        count = held["c"].count
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    lengths.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    n_tokens = F.pandas_udf(lengths, "long")(F.col(text_col))
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    out = docs.select(F.col(id_col).alias("doc_id"), n_bytes.alias("n_bytes"), n_tokens.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents")))
