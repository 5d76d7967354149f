"""Session factory and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths to delete at the end of the process: lazy results may read them until then.
_MADE: list[tuple[SparkSession, str]] = []


def get_session(cores: int | str = "*", app: str = "rankfold", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster's; `partitions` suits a few cores."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one is made only where it names none, as in tests."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankfold-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses; what is written there goes at the end of the process."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df below the shared folder and read it back: the result has no lineage to lose."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def clean() -> None:
    """Delete all that materialize() and fresh_path() have made; results that read it end with that."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # a session that has stopped
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
