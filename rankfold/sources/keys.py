"""Readers and writers: key files, records, page folders, operation streams, persisted models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.generators import code_of
from ..session import fresh_path  # noqa: F401

SEGMENT_BYTES = np.dtype([("first_key", "<i8"), ("slope", "<f8"), ("first_rank", "<i8"), ("last_rank", "<i8"), ("max_err", "<i8")])


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One file of a small local value, on any file system that Spark writes to."""
    fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(data))
    out.close()


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, where = _hadoop(spark, path)
    return fs.getContentSummary(where).getLength()


def read_keys(spark: SparkSession, path: str, dtype: str = "<u8", skip: int = 1, record_bytes: int = 0, place: str = "") -> DataFrame:
    """Keys of binary files after `skip` header words, as DECIMAL(20,0); no Python object is made for a key.

    record_bytes > 0: a key stands at the head of each record of that size.  `place` names a column
    for a key's place in its file.  Spark hands a file over whole, so one must stay under its 2 GB
    for a value: a larger set of keys comes as several files.
    """
    width = np.dtype(dtype).itemsize
    step = record_bytes or width

    def made(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                body = np.frombuffer(raw, np.uint8)[skip * width :]
                rows = body[: len(body) // step * step].reshape(-1, step)[:, :width]
                keys = np.ascontiguousarray(rows).view(dtype).ravel()
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i : i + (1 << 16)]
                    columns = [pa.array(part).cast(pa.decimal128(20, 0))]
                    if place:
                        columns.append(pa.array(np.arange(i, i + len(part))))
                    yield pa.RecordBatch.from_arrays(columns, ["key", place][: len(columns)])

    schema = "key decimal(20,0)" + (f", {place} long" if place else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(made, schema)


def header_words(spark: SparkSession, path: str, words: int) -> list[int]:
    """The first unsigned 64-bit words of a file; only they reach the driver."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8 * words).alias("h")).first()["h"]
    return [int(x) for x in np.frombuffer(bytes(head), "<u8")]


def write_keys(keys: list[int], path: str, dtype: str = "<u8") -> None:
    """A key file of a small local list, as fixtures need it: its length, then the keys."""
    with open(path, "wb") as f:
        f.write(np.array([len(keys), *keys], dtype).tobytes())


def read_text_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of text files, one a line; other lines are left out."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) as bigint)").alias("key")).filter("key is not null")


def parse_operations(lines: DataFrame, column: str = "value") -> DataFrame:
    """(op, key, len) of lines `OP key [len]`; len is null but for scans."""
    part = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(part[0].alias("op"), part[1].cast("long").alias("key"), F.get(part, F.lit(2)).cast("int").alias("len"))


def write_streams(ops: DataFrame, path: str) -> None:
    """Operations (op_id, op, key, len) as three streams below `path`: codes, keys, range lengths of scans."""
    coded = ops.select("op_id", code_of(F.col("op")).alias("op"), "key", "len")
    for name, columns, kept in (("ops", ["op_id", "op"], F.lit(True)), ("keys", ["op_id", "key"], F.lit(True)), ("lengths", ["op_id", "len"], F.col("len").isNotNull())):
        coded.filter(kept).select(*columns).repartitionByRange("op_id").sortWithinPartitions("op_id").write.parquet(f"{path}/{name}")


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """(op_id, op, key, len) of write_streams()."""
    ops = spark.read.schema("op_id long, op int").parquet(f"{path}/ops")
    keys = spark.read.schema("op_id long, key long").parquet(f"{path}/keys")
    lengths = spark.read.schema("op_id long, len int").parquet(f"{path}/lengths")
    return ops.join(keys, "op_id").join(lengths, "op_id", "left")


def write_pages(ranked: DataFrame, path: str, files: int) -> None:
    """Key-ordered Parquet files, so that row-group statistics work as a zone map."""
    ranked.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def write_page_files(paged: DataFrame, path: str) -> None:
    """Pages in a folder for each file_id, sorted, so that reads of few pages open few folders."""
    paged.repartitionByRange("file_id", "page_id").sortWithinPartitions("file_id", "page_id", "rank").write.partitionBy("file_id").parquet(path)


def read_page_files(spark: SparkSession, path: str, schema: str, wanted: Column) -> DataFrame:
    """Rows of the pages for which `wanted` holds; a condition on file_id prunes folders, one on page_id row groups."""
    return spark.read.schema(f"{schema}, file_id long").parquet(path).filter(wanted)


def save_index(path: str, data: DataFrame, model: DataFrame) -> None:
    """Keys with ranks and their model under one path."""
    data.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/data")
    model.write.parquet(f"{path}/model")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/model")


def bytes_of_model(segments: DataFrame, each: int = 1024) -> DataFrame:
    """(part, n, data): segments as fixed-width records, about `each` in a value."""
    names = list(SEGMENT_BYTES.names)

    def made(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, each):
                part = batch.slice(i, each)
                rows = np.zeros(part.num_rows, SEGMENT_BYTES)
                for c in names:
                    rows[c] = part.column(c).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([rows.tobytes()], pa.binary())], ["n", "data"])

    return segments.select(*names).mapInArrow(made, "n long, data binary")


def model_of_bytes(parts: DataFrame) -> DataFrame:
    """The segments of bytes_of_model()."""
    names = list(SEGMENT_BYTES.names)

    def made(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                rows = np.frombuffer(data, SEGMENT_BYTES)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in names], names)

    return parts.mapInArrow(made, "first_key long, slope double, first_rank long, last_rank long, max_err long")


def aligned_blocks(sizes: DataFrame, page: int = 4096) -> DataFrame:
    """sizes (block_id, n_bytes) with the padded size of each block."""
    return sizes.withColumn("padded", F.ceil(F.col("n_bytes") / page).cast("long") * page)
