"""A levelled store: a sorted buffer and levels of growing capacity, each an immutable sorted table.

A change goes to the buffer; a buffer above its capacity is merged into the first level, and a level
above its capacity into the next one, newest version first.  A deletion is a tombstone, which hides
older versions and is dropped when it reaches the last level that holds rows.  Every level is one
written table with its number of rows and its least and greatest key, so that lookups skip levels
whose zone cannot hold the key.  A store is a value: changes return a new one whose manifest names
the tables of its version, so readers of the old version go on undisturbed; publish() makes a
manifest current only if nobody else has published since the version that it was made from.

Defined results: a missing key gives null; changes with equal keys in one batch are ordered by seq,
then by deletion, then by value; null keys are refused by filters and never stored; an empty store
answers every query with no rows or nulls.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .ranking import with_rank
from .store import COLUMNS, newest, split

SCHEMA = "key long, value long, seq long, deleted boolean"


@dataclass(frozen=True)
class Level:
    rows: DataFrame
    n: int
    lo: int | None
    hi: int | None


@dataclass(frozen=True)
class Levels:
    """levels[0] is the buffer; level i holds at most buffer_rows * base^i rows."""

    spark: SparkSession
    levels: tuple[Level | None, ...] = (None,)
    buffer_rows: int = 1 << 16
    base: int = 4
    version: int = 0
    merges: int = 0

    def capacity(self, i: int) -> int:
        return self.buffer_rows * self.base**i

    def _level(self, rows: DataFrame, name: str) -> Level | None:
        held = materialize(rows.repartitionByRange("key").sortWithinPartitions("key"), name)
        n, lo, hi = held.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        return Level(held, n, lo, hi) if n else None

    def insert(self, changes: DataFrame) -> Levels:
        """changes (key, value, seq, deleted) on top of all that is stored."""
        levels, merges = list(self.levels), self.merges
        # Newest first: the batch, then the buffer, then each level that overflows.
        rising = self._level(newest(changes.filter("key is not null"), *([levels[0].rows] if levels[0] else [])), "buffer")
        i = 0
        while rising is not None and rising.n > self.capacity(i):
            if i + 1 == len(levels):
                levels.append(None)
            below = levels[i + 1]
            merged = newest(rising.rows, *([below.rows] if below else []))
            if not any(levels[i + 2 :]):
                merged = merged.filter(~F.col("deleted"))
            levels[i], merges, i = None, merges + 1, i + 1
            rising = self._level(merged, f"level-{i}")
        levels[i] = rising
        return replace(self, levels=tuple(levels), version=self.version + 1, merges=merges)

    def _all(self) -> list[DataFrame]:
        return [x.rows for x in self.levels if x]

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """Live rows (key, value, seq) of all levels."""
        return newest(*(self._all() or [self.empty()])).filter(~F.col("deleted")).select("key", "value", "seq")

    def find(self, probes: DataFrame) -> DataFrame:
        """(probe, value): the newest live value of each probe, or null; only rows that a probe names are merged."""
        asked = probes.select(F.col("probe").alias("key")).distinct()
        hit = [x.join(asked, "key", "left_semi") for x in self._all()] or [self.empty()]
        found = newest(*hit).filter(~F.col("deleted")).select(F.col("key").alias("probe"), "value")
        return probes.select("probe").join(found, "probe", "left")

    def between(self, low: int, high: int) -> DataFrame:
        """(key, value) of the closed interval in the order of keys: newest version of each level that reaches into it, tombstones removed."""
        touched = [x.rows for x in self.levels if x and x.lo <= high and x.hi >= low]
        part = [x.filter(F.col("key").between(low, high)) for x in touched] or [self.empty()]
        return newest(*part).filter(~F.col("deleted")).select("key", "value").orderBy("key")

    def lower_bound(self, probes: DataFrame) -> DataFrame:
        """(probe, key, value): the least live key at or above each probe."""
        from .ranking import asof

        # A floor search on negated keys is a ceiling search.
        held = self.rows().select((-F.col("key")).alias("down"), "key", "value")
        out = asof(probes.select("probe", (-F.col("probe")).alias("p")), held, "p", "down", ["key", "value"])
        return out.select("probe", "key", "value")

    def size(self) -> int:
        return self.rows().count()

    def ordered(self) -> DataFrame:
        """Live rows with their place in the order of keys."""
        return with_rank(self.rows().select("key", "value"), "key", name="at")

    def sizes(self) -> DataFrame:
        """(level, n, capacity) of the levels that hold rows."""
        held = [(i, x.n, self.capacity(i)) for i, x in enumerate(self.levels) if x]
        return self.spark.createDataFrame(held, "level int, n long, capacity long")

    def publish(self, name: str) -> bool:
        """Make this version the current one of the store `name`; False if another was published since.

        The manifest of a version is a file of its number, and creating a file fails if it is there.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark).rstrip('/')}/store-{name}/{self.version:012d}")
        fs = path.getFileSystem(conf)
        try:
            out = fs.create(path, False)
        except Exception as e:  # the JVM's error for a file that exists has no class of its own here
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        files = [{"level": i, "files": x.rows.inputFiles(), "n": x.n} for i, x in enumerate(self.levels) if x]
        out.write(bytearray(json.dumps({"version": self.version, "levels": files, "id": uuid.uuid4().hex}).encode()))
        out.close()
        return True


def drain(buffer: DataFrame, keep: int = 100) -> tuple[DataFrame, DataFrame]:
    """(kept, drained) of a full buffer (COLUMNS): every (n div keep)-th row of the first `keep` such stays, the rest goes to be merged."""
    ranked = materialize(split(with_rank(buffer.select(*COLUMNS), "key"), buffer.count(), keep), "drained")
    return ranked.filter("in_buffer").select(*COLUMNS), ranked.filter("not in_buffer").select(*COLUMNS)


def merge_sorted(*tables: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """A k-way merge: one range partitioning of all tables, each partition sorted; the result has a global order by its `at`."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return with_rank(rows, *by, name="at")
