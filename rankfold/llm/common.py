"""Shared helpers: scratch tables on cluster-wide storage, word patterns, batch slicing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words between ASCII white space; other control or Unicode spaces belong to words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters, digits and all non-ASCII characters, after lower_ascii().
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTER_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one is made only where the session names none."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        held = spark.sparkContext.getCheckpointDir()
    if not held:
        held = tempfile.mkdtemp(prefix="rankfold-")
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir()
    return held


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer splits than cores is dealt out anew before slow per-row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a few numbers up to which sized() sends a table to all executors: 48 MB at 96 bytes a row.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of `rows` rows of a few numbers each, to be broadcast where that is few; else joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in batches of at most `rows` for the rest of the session: it bounds their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


class Scratch:
    """Tables written under the shared checkpoint folder; they cut lineage and outlive executors.

    A table stays until drop() or the end of the driver's process, as lazy results may read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a DataFrame that reads it back."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        # The shuffle files of this one write are of no use after it.
        self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before) if before is not None else self.spark.conf.unset(key)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

