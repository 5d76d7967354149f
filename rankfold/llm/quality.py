"""Quality rules: statistics of whole texts, and decision lists learned by sequential covering.

Statistics are exact integers from one pass over each text.  A decision list is an ordered list of
conjunctions of thresholds on ratios of them.  Sequential covering grows a conjunction for the
class `reject` on two thirds of the labelled rows, one threshold at a time by the gain in
log-precision; prunes it on the last third; keeps it if it is precise there; removes the rows it
covers; and goes on.  The list is emitted as one Spark conditional expression, ordered as learned;
what no rule covers is kept.

The list is fitted on a bounded sample: about `sample_rows` labelled documents, chosen by a hash.
Defined results: a null text is empty; null labels or ids train nothing; without labels the list
is empty and only the base rules reject; repeated rows are judged alike; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, small_batches, spread, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_alpha", "n_digits", "n_marks", "n_distinct")
#: Ratios that rules may test, as SQL over the counts.
RATIOS = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "alpha": "n_alpha / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
WORDS = re.compile(SPACE_WORD)
# The counted classes of ASCII characters.
CLASSES = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_alpha": bytes([*range(65, 91), *range(97, 123)]), "n_digits": b"0123456789", "n_marks": b"!?"}
CLASS_BYTES = {name: np.frombuffer(chars, np.uint8) for name, chars in CLASSES.items()}


def repeated_words(words: list[str]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, counted once each; distinct words)."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(words))}
    n = len(words)
    if n < 4:
        return 0, len(ids)
    w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) < 1 << 21:
        windows = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:
        pairs = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
        windows = pairs * len(ids) + w[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0, len(ids)
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum()), len(ids)


def text_counts(text: str | None) -> tuple:
    """The COUNTS of one text; n_alpha takes every character outside ASCII for a letter."""
    text = text or ""
    words = WORDS.findall(text)
    lines = list(filter(WORDS.search, text.split("\n")))
    repeats, distinct = repeated_words(words)
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    of = {name: int(seen[chars].sum()) for name, chars in CLASS_BYTES.items()}
    of["n_alpha"] += int(seen[0xC0:].sum())  # first bytes of longer UTF-8 sequences
    return (
        len(words), sum(map(len, words)), of["n_symbols"], len(lines) - len(set(lines)), len(lines), repeats,
        of["n_upper"], of["n_alpha"], of["n_digits"], of["n_marks"], distinct,
    )


def with_counts(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """docs with a struct column of COUNTS."""
    small_batches(docs.sparkSession)

    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")

    counted.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return docs.withColumn(name, F.pandas_udf(counted, ", ".join(f"{c} long" for c in COUNTS))(F.col(text_col)))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, counts: str) -> Column:
        value = F.col(f"{counts}.{self.feature}")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Test, ...], ...]

    def rejects(self, ratios: str) -> Column:
        """The ordered conditional over a struct column of RATIOS."""
        out = F.lit(False)
        for rule in reversed(self.rules):
            every = F.lit(True)
            for t in rule:
                every = every & t.column(ratios)
            out = F.when(every, F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in r) for r in self.rules)


def _grow(x: pd.DataFrame, y: np.ndarray, most_tests: int, cuts: int) -> tuple[Test, ...]:
    """Add the threshold with the largest gain p * (log precision after - before) until none helps."""
    rule, inside = (), np.ones(len(y), bool)
    while len(rule) < most_tests and y[inside].any() and not y[inside].all():
        before, best = np.log2(y[inside].mean()), (1e-9, None, None)
        for feature in x.columns:
            v = x[feature].to_numpy()
            for threshold in np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts + 1)[1:-1], method="nearest")):
                for above in (True, False):
                    now = inside & (v > threshold if above else v <= threshold)
                    if (p := y[now].sum()) and (gain := p * (np.log2(p / now.sum()) - before)) > best[0]:
                        best = (gain, Test(feature, above, float(threshold)), now)
        if best[1] is None:
            break
        rule, inside = (*rule, best[1]), best[2]
    return rule


def _cover(rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def learn(x: pd.DataFrame, reject: np.ndarray, *, most_rules=12, most_tests=4, precision=0.9, least=3, cuts=64) -> DecisionList:
    """Sequential covering over rows x of RATIOS; `reject` is the class to cover."""
    third = np.arange(len(x)) % 3 == 2
    grow_x, grow_y, prune_x, prune_y = x[~third], reject[~third], x[third], reject[third]
    rules = []
    while len(rules) < most_rules and grow_y.any():
        rule = _grow(grow_x, grow_y, most_tests, cuts)
        if not rule:
            break

        def worth(r):
            held = prune_y[_cover(r, prune_x)]
            return (2 * held.sum() - len(held)) / max(1, len(held)), held.sum()

        # Drop final tests as long as the rule does not lose on the rows that did not grow it.
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside, held = _cover(rule, grow_x), prune_y[_cover(rule, prune_x)]
        both = np.concatenate([grow_y[inside], held])
        if both.sum() >= least and both.mean() >= precision and (not len(held) or held.mean() >= precision):
            rules.append(rule)
        grow_x, grow_y = grow_x[~inside], grow_y[~inside]
        keep = ~_cover(rule, prune_x)
        if rules and rules[-1] is rule:
            prune_x, prune_y = prune_x[keep], prune_y[keep]
    return DecisionList(tuple(rules))


def with_ratios(counted: DataFrame, counts: str = "stats", name: str = "ratios") -> DataFrame:
    made = []
    for r, sql in RATIOS.items():
        for c in COUNTS:
            sql = re.sub(rf"\b{c}\b", f"{counts}.{c}", sql)
        made.append(F.expr(sql).alias(r))
    return counted.withColumn(name, F.struct(*made))


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", sample_rows: int = 20_000, **how) -> DecisionList:
    """Learn from `labels` (doc_id, quality: 0 is rejected) joined with their documents.

    Rows that the base rules reject are left out, as the list never judges them.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), "quality").filter("label_id is not null and quality is not null")
    n = known.count()
    if not n:
        return DecisionList(())
    share = max(1, min(1 << 20, (1 << 20) * sample_rows // n))
    known = known.filter(f"pmod(xxhash64(label_id), {1 << 20}) < {share}")
    # About `sample_rows` ids of 16 bytes: small enough to send to every executor.
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "label_id")
    rows = with_ratios(with_counts(rows, "text")).filter(~base_failed("stats")).select("label_id", "quality", F.xxhash64("label_id").alias("h"), "ratios.*").toPandas()
    rows = rows.sort_values(["h", "label_id", "quality"]).reset_index(drop=True)
    return learn(rows[list(RATIOS)], (rows["quality"] == 0).to_numpy(), **how)


def base_failed(counts: str) -> Column:
    return (F.col(f"{counts}.n_words") < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * F.col(f"{counts}.n_words"))


def judge_quality(docs: DataFrame, rules: DecisionList, *, text_col: str = "text", name: str = "stats") -> DataFrame:
    """docs with the struct `stats` of COUNTS, base_failed and kept."""
    out = with_ratios(with_counts(docs, text_col, name), name, "_ratios")
    out = out.withColumn("base_failed", base_failed(name))
    return out.withColumn("kept", ~F.col("base_failed") & ~rules.rejects("_ratios")).drop("_ratios")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = judge_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[f"stats.{c}" for c in base], "base_failed", "kept")
