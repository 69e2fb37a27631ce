"""Measurement files as numbered text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``lines(dataset_id, row_idx, line)`` of text files of any size; large files are read in splits.

    ``row_idx`` is the byte offset of the split plus the row's place in its task.  It grows along the file
    and is unique in it, because a line takes at least one byte and only the last split of a file
    shares a task with other files.  No shuffle is needed to number the lines.  The number of splits
    is pinned in the session, so that later scans number alike when executors come and go.
    """
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("dataset_id"),
        (F.col("_metadata.file_block_start") + place).alias("row_idx"),
        F.col("value").alias("line"),
    )


def empty_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``dataset_id`` of files of length zero, which yield no line.

    Names come from the file listing that Spark keeps for the scan; no content is read.
    """
    names = [name.replace("file:///", "file:/", 1) for name in spark.read.text(_paths(paths)).inputFiles()]
    listed = spark.createDataFrame([(name,) for name in names], "dataset_id string")
    filled = spark.read.format("binaryFile").load(_paths(paths)).select(
        F.col("_metadata.file_path").alias("dataset_id")
    )
    return listed.join(filled, "dataset_id", "left_anti")


def read_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``files(dataset_id, content)``: one row per file, for files of laboratory size."""
    return spark.read.text(_paths(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("dataset_id"), F.col("value").alias("content")
    )


def split_lines(files: DataFrame) -> DataFrame:
    """``lines`` from ``files(dataset_id, content)``; an empty content gives one empty line."""
    return files.select(
        "dataset_id", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("row_idx", "line")
    ).select("dataset_id", F.col("row_idx").cast("bigint"), "line")
