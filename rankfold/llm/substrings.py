"""Substring deduplication with a log-structured index of window fingerprints.

A window is `width` consecutive words.  A word is removed if a window that covers it has the same
words as one that starts earlier: in a row of smaller (doc_id, row key), or before it in its row.

Each batch of documents is reduced to winnowed fingerprints: every position whose `gram`-word hash
is the least of some window, so that equal windows always share a fingerprint.  They become one
run of the index: rows (fp, rk, m) - fingerprint, row key, times in the row - sorted by
fingerprint and never changed.  A batch's run is merge-joined with the runs before it; only
windows around fingerprints that occur twice or more are hashed in full (64 bits, and 64 more of an
unlike function that verify them), and the first of equal ones stays.  When more
than `fanout` runs have piled up, they are compacted into one.

Windows are dealt to shards by their fingerprint, so that the repeats around one come back as one
span.  Those of a hot fingerprint, one with HOT occurrences or more, are dealt by their own hashes
and a number of their slice of text first; the first ones of equals in such a salted shard meet in
a second round.  In runs, a hot fingerprint is range-partitioned with the row key.  Equal windows
are reduced to their first one in every slice of a map task before any shuffle.

Defined results: a null text has no words; null ids sort first; rows with equal id and text are one
document and get the same result; rows with equal id and different texts are ordered by a hash;
empty tables give empty results; only the named columns are read.  Hashing takes a long text in
overlapping pieces of SLICE bytes; the words that stay are cut from the whole text, as its list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, spread, table
from .rolling import chain, mix, sliding, word_slices

NO_ID = -(1 << 63)
#: Groups of marks that need no comparison, numbered after all shards.
MARKED = 256
PAYLOAD = "shard int, docs binary, rks binary, fresh binary, firsts binary, h binary, c binary, at binary"
MARKS = "doc long, rk long, span long"  # span: first start << 32 | number of starts
#: Occurrences from which on a fingerprint's windows are dealt by their own hashes, to so many salted shards each.
HOT, SALTS = 4096, 16


def planes(x: np.ndarray) -> bytes:
    """The bytes of unsigned integers, all low ones first: the high ones are mostly zero and pack well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def anchors(words, ids, width: int, gram: int):
    """(anchor hash of each window start, whether the window is whole, gram hashes, selected grams)."""
    grams = chain(ids, gram)
    whole = words.inside(width)
    least = sliding(grams, width - gram + 1, np.minimum)[: len(whole)]
    held = np.where(whole, least, np.uint64(0))
    # A gram is selected if it equals the greatest of the minima of the windows that hold it.
    padded = np.concatenate([np.zeros(width - gram, np.uint64), held, np.zeros(width - gram, np.uint64)])
    selected = (grams == sliding(padded, width - gram + 1, np.maximum)) & (grams != 0)
    return least, whole, grams, selected


def fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(fp, rk, m) of docs (rk, text)."""

    def made(batches):
        for batch in batches:
            rk = batch.column("rk").to_numpy()
            for row, words, _ in word_slices(batch.column("text"), width):
                if len(words.starts) < width:
                    continue
                _, _, grams, selected = anchors(words, words.hashes()[0], width, gram)
                at = np.flatnonzero(selected)
                fp, doc = grams[at].view(np.int64), words.doc[at]
                order = np.lexsort((fp, doc))
                fp, doc = fp[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])) if len(fp) else at
                times = np.diff(np.append(new, len(fp))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), pa.array(rk[row + doc[new]]), pa.array(times)], ["fp", "rk", "m"])

    return docs.select("rk", "text").mapInArrow(made, "fp long, rk long, m int")


def candidate_windows(docs: DataFrame, width: int, gram: int, shards: int) -> DataFrame:
    """PAYLOAD rows of docs (doc, rk, fresh, text, fps, hot): windows at the fingerprints fps, by shards.

    hot are those of the fingerprints whose windows are dealt by their own hashes.

    Of equal windows in a slice only the first goes on; the positions of the others in fresh rows are
    sent as marks (h empty).
    """

    def made(batches):
        slices = 0
        for batch in batches:
            doc, rk, fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "rk", "fresh"))
            fps, hot = batch.column("fps"), batch.column("hot")
            for row, words, skipped in word_slices(batch.column("text"), width):
                if len(words.starts) < width:
                    continue
                stop, slices = row + len(words.counts), slices + 1
                ids, more = words.hashes()
                first = words.first - skipped
                least, whole, _, _ = anchors(words, ids, width, gram)
                # A pair of row and fingerprint as one number: a collision only adds a candidate.
                mine = least ^ _salt(words.doc[: len(least)])
                at = np.flatnonzero(whole & _among(mine, fps.slice(row, stop - row)))
                if not len(at):
                    continue
                h, c = chain(ids, width)[at], chain(more, width)[at]
                d = words.doc[at]
                # Rows of the slice in the order of documents, then positions.
                place = np.empty(stop - row, np.int64)
                place[np.lexsort((rk[row:stop], doc[row:stop]))] = np.arange(stop - row)
                order = np.lexsort((at, place[d], c, h))
                h, c, d, at = h[order], c[order], d[order], at[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                again = (doc[row + d] != doc[row + d[lead]]) | (rk[row + d] != rk[row + d[lead]]) | (at - first[d] != at[lead] - first[d[lead]])
                again &= fresh[row + d]
                if again.any():
                    da, pa_ = d[again], (at - first[d])[again]
                    o = np.lexsort((pa_, da))
                    da, pa_ = da[o], pa_[o]
                    cut = np.flatnonzero(np.concatenate([[True], da[1:] != da[:-1]]))
                    for a, b in zip(cut, np.append(cut[1:], len(da)), strict=True):
                        x = row + da[a]
                        yield _mark(shards * (1 + SALTS) + int(rk[x]) % MARKED, doc[x], rk[x], pa_[a:b])
                h, c, at = h[new], c[new], at[new]
                salted = np.isin(least[at].view(np.int64), np.unique(hot.slice(row, stop - row).flatten().to_numpy()))
                by = np.where(salted, h, mix(least[at] ^ np.uint64(1)))
                shard = ((by >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                # Salted shards are numbered after the others.
                shard = np.where(salted, shards + shard * SALTS + int(rk[row] + slices) % SALTS, shard)
                order = np.argsort(shard, kind="stable")
                h, c, at, shard = h[order], c[order], at[order], shard[order]
                bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                for a, b in zip(bounds, np.append(bounds[1:], len(shard)), strict=True):
                    use = np.unique(words.doc[at[a:b]])
                    tables = (doc[row + use].tobytes(), rk[row + use].tobytes(), fresh[row + use].astype(np.uint8).tobytes(), first[use].astype(np.int64).tobytes())
                    yield _payload(int(shard[a]), *tables, h[a:b].tobytes(), c[a:b].tobytes(), planes(at[a:b]))

    return docs.select("doc", "rk", "fresh", "text", "fps", "hot").mapInArrow(made, PAYLOAD)


def _salt(row: np.ndarray) -> np.ndarray:
    return (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _among(mine: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each salted value is one of the lists', salted by their row."""
    known = lists.flatten().to_numpy().view(np.uint64)
    if not len(known):
        return np.zeros(len(mine), bool)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.sort(known ^ _salt(np.repeat(np.arange(len(lists)), sizes)))
    found = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
    return pairs[found] == mine


_TYPES = pa.schema([("shard", pa.int32()), *[(n, pa.binary()) for n in ("docs", "rks", "fresh", "firsts", "h", "c", "at")]])


def _payload(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, _TYPES, strict=True)], schema=_TYPES)


def _mark(shard: int, doc, rk, at: np.ndarray) -> pa.RecordBatch:
    return _payload(shard, np.int64(doc).tobytes(), np.int64(rk).tobytes(), b"", b"", b"", b"", planes(at))


def _spans(marks: list) -> pa.Table:
    """MARKS of (doc, rk, start) arrays: starts one after the other in a row are one span."""
    doc, rk, at = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((at, rk, doc))
    doc, rk, at = doc[order], rk[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1]) | (at[1:] > at[:-1] + 1)])) if len(at) else order
    n = at[np.append(new[1:], len(at)) - 1] - at[new] + 1 if len(at) else at
    return pa.table({"doc": pa.array(doc[new]), "rk": pa.array(rk[new]), "span": pa.array((at[new] << 32) | n)})


def _first_round(shards: int):
    """MARKS of one shard, and of a salted one the firsts of equals as rows of the shard that they meet in."""

    def made(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        marks, firsts = _later(group)
        out, number = _spans(marks), key[0].as_py()
        n = out.num_rows
        rows = [out.append_column("shard", pa.nulls(n, pa.int32()))]
        for name in _TYPES.names[1:]:
            rows[0] = rows[0].append_column(name, pa.nulls(n, pa.binary()))
        if number >= shards and firsts is not None:
            h, c, doc, rk, at, fresh = firsts
            order = np.lexsort((at, rk, doc))
            h, c, doc, rk, at, fresh = (x[order] for x in (h, c, doc, rk, at, fresh))
            # Rows of documents become tables of their places, as candidate_windows() makes them.
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1])]))
            size = np.maximum.reduceat(at, new) + 1
            base = np.cumsum(size) - size
            place = at + np.repeat(base, np.diff(np.append(new, len(at))))
            values = (doc[new].tobytes(), rk[new].tobytes(), fresh[new].astype(np.uint8).tobytes(), base.astype(np.int64).tobytes(), h.tobytes(), c.tobytes(), place.astype(np.int64).tobytes())
            none = pa.nulls(1, pa.int64())
            row = [none, none, none, pa.array([(number - shards) // SALTS], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
            rows.append(pa.Table.from_arrays(row, rows[0].column_names))
        return pa.concat_tables(rows)

    return made


def _second_round(group: pa.Table) -> pa.Table:
    return _spans(_later(group, np.int64)[0])


def _later(group: pa.Table, places=None):
    """((doc, rk, start) arrays of windows in fresh rows that are not the first of their equals, the firsts)."""
    parts, marks = [], []
    for r in group.to_pylist():
        at = np.frombuffer(r["at"], places) if places else unplanes(r["at"]).astype(np.int64)
        docs, rks = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["rks"], np.int64)
        if not r["h"]:
            marks.append((np.repeat(docs, len(at)), np.repeat(rks, len(at)), at))
            continue
        firsts, fresh = np.frombuffer(r["firsts"], np.int64), np.frombuffer(r["fresh"], np.uint8)
        d = np.searchsorted(firsts, at, "right") - 1
        parts.append((np.frombuffer(r["h"], np.uint64), np.frombuffer(r["c"], np.uint64), docs[d], rks[d], at - firsts[d], fresh[d]))
    if not parts:
        return marks, None
    h, c, doc, rk, at, fresh = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, rk, doc, c, h))
    h, c, doc, rk, at, fresh = (x[order] for x in (h, c, doc, rk, at, fresh))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = ((doc != doc[lead]) | (rk != rk[lead]) | (at != at[lead])) & (fresh > 0)
    marks.append((doc[again], rk[again], at[again]))
    return marks, tuple(x[new] for x in (h, c, doc, rk, at, fresh))


@dataclass
class Index:
    """Runs of fingerprints of the documents added so far, and the marks found in them."""

    scratch: Scratch
    width: int = 20
    gram: int = 8
    fanout: int = 4
    shard_bytes: int = 4 << 20
    runs: list[tuple[str, DataFrame]] = field(default_factory=list)
    marks: list[DataFrame] = field(default_factory=list)
    made: int = 0

    def _save_run(self, rows: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        # Ranges of (fp, rk) split a fingerprint that very many rows share.
        return name, self.scratch.save(rows.repartitionByRange("fp", "rk").sortWithinPartitions("fp", "rk"), name)

    def compact(self) -> None:
        if len(self.runs) > self.fanout:
            old, rows = self.runs, self.runs[0][1]
            for _, r in old[1:]:
                rows = rows.unionByName(r)
            self.runs = [self._save_run(rows)]
            for name, _ in old:
                self.scratch.drop(name)

    def add(self, batch: DataFrame, history: DataFrame | None) -> None:
        """Find the repeats in batch (doc, rk, text), all of whose ids are above those of history."""
        self.compact()
        k = self.made + 1
        raw = self.scratch.save(fingerprints(batch, self.width, self.gram), f"raw-{k}")
        name, run = self._save_run(raw)
        self.scratch.drop(f"raw-{k}")
        own = run.groupBy("fp").agg(F.sum("m").alias("n"))
        every = run
        if self.runs:
            old = self.runs[0][1]
            for _, r in self.runs[1:]:
                old = old.unionByName(r)
            every = run.unionByName(old)
            own = own.join(old.groupBy("fp").agg(F.sum("m").alias("old")), "fp", "left").filter("n >= 2 or old >= 1")
            own = own.withColumn("n", F.col("n") + F.coalesce("old", F.lit(0)))
        else:
            own = own.filter("n >= 2")
        twice = self.scratch.save(own.select("fp", (F.col("n") >= HOT).alias("hot")), f"twice-{k}")
        held = every.join(twice, "fp").groupBy("rk").agg(F.collect_list("fp").alias("fps"), F.collect_list(F.when(F.col("hot"), F.col("fp"))).alias("hot"))
        held = self.scratch.save(held, f"held-{k}")
        self.scratch.drop(f"twice-{k}")
        docs = batch.withColumn("fresh", F.lit(True))
        if history is not None and self.runs:
            docs = docs.unionByName(history.withColumn("fresh", F.lit(False)))
        size = batch.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = 1 + int(size) // self.shard_bytes
        payload = candidate_windows(docs.join(held, "rk"), self.width, self.gram, shards)
        both = payload.groupBy("shard").applyInArrow(_first_round(shards), f"{MARKS}, {PAYLOAD}")
        both = self.scratch.save(both, f"marks-{k}")
        met = both.filter("shard is not null").select(*_TYPES.names).groupBy("shard").applyInArrow(_second_round, MARKS)
        self.marks.append(both.filter("shard is null").select("doc", "rk", "span").unionByName(self.scratch.save(met, f"met-{k}")))
        self.scratch.drop(f"held-{k}")
        self.runs.append((name, run))


def _removed(width: int):
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, marks, strict=True):
            words = text.encode().split() if text else []
            n = len(words)
            gone = 0
            if at is not None and len(at):
                edge, spans = np.zeros(n + width + 1, np.int32), np.asarray(at, np.int64)
                start = spans >> 32
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (spans & 0xFFFFFFFF) - 1 + width, -1)
                stay = np.cumsum(edge[:n]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone = n - len(words)
            rows.append((n, gone, b" ".join(words).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    cut.__annotations__ = {"texts": pd.Series, "marks": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(cut, "n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", width: int = 20, gram: int = 8, batches: int = 3, fanout: int = 1, keep=(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, the columns `keep`, n_words, n_removed and kept (the words that stay, joined by a space).

    The rows are added to a new index in `batches` ranges of their ids, the smallest ids first.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    small_batches(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    keyed = spread(keyed)
    cuts = keyed.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    index = Index(scratch, width, gram, fanout)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = keyed
        if low is not None:
            batch = batch.filter(F.col("doc") > low)
        if high is not None:
            batch = batch.filter(F.col("doc") <= high)
        index.add(batch, None if low is None else keyed.filter(F.col("doc") <= low))
    marks = index.marks[0]
    for m in index.marks[1:]:
        marks = marks.unionByName(m)
    marks = marks.groupBy(F.col("doc").alias("_doc"), F.col("rk").alias("_rk")).agg(F.collect_list("span").alias("_at"))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    rows = rows.join(marks, (F.col("_key") == F.col("_rk")) & (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("_doc")), "left")
    out = rows.select("doc_id", *keep, _removed(width)("_text", "_at").alias("_r"))
    return out.select("*", "_r.*").drop("_r")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS t FROM pos),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM later)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
