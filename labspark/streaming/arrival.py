"""Analysis of measurement files as they arrive in a landing folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labspark.operators.ordered import BLOCK_ROWS
from labspark.plans.analysis import analyse
from labspark.session import cut_lineage
from labspark.sources.lines import split_lines

Tables = Mapping[str, DataFrame]
#: What a micro-batch leaves behind; ``files`` is added to them.
TABLES = "errors statistics profile resonance_points resonance regression latitude items preview_blocks reports".split()
_VERSION = ["version", "path"]
#: So many tables of a batch are computed at the same time; the jobs of a batch are short, and most of them wait.
TABLES_AT_ONCE = 6


def stream_files(
    spark: SparkSession, folder: str, max_files: int | None = None, name: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Streaming ``lines`` of whole files; a file belongs to exactly one micro-batch.

    ``name`` makes the dataset's id of a file's path (default: the path itself).  A file that is delivered
    again under another path may so replace the earlier one: ``version`` is its time of modification.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    files = reader.load(folder).select(
        (name(path) if name else path).alias("dataset_id"),
        F.col("_metadata.file_modification_time").alias("version"),
        path.alias("path"),
        F.col("value").alias("content"),
    )
    lines = split_lines(files.withColumn("dataset_id", F.struct("dataset_id", *_VERSION)))
    return lines.select("dataset_id.*", "row_idx", "line")


def latest_files(files: DataFrame) -> DataFrame:
    """One row per dataset: its last version, of files modified at the same time the one with the greatest path."""
    newest = F.max(F.struct(*_VERSION, *[c for c in files.columns if c not in ("dataset_id", *_VERSION)]))
    return files.groupBy("dataset_id").agg(newest.alias("f")).select("dataset_id", "f.*")


def arrival_tables(lines: DataFrame, metadata: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> Tables:
    """The whole analysis of the files of one micro-batch: the batch transformations.

    The files are read once, into the checkpoint folder.  What the other tables are made of comes first.
    """
    result = analyse(cut_lineage(lines), metadata, block_rows)
    _ = result.layouts
    at_once(lines.sparkSession, lambda name: getattr(result, name), ["statistics", "profile", "regression"])
    return {name: getattr(result, name) for name in TABLES}


def at_once(spark: SparkSession, work: Callable[[str], object], names: Iterable[str]) -> None:
    """``work`` for each name, by threads that share the properties of this one; the first error is raised at the end."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(work), name) for name in names]:
            done.result()


def _commit(spark: SparkSession, out: str, batch_id: int, attempt: str, versions: bool) -> None:
    row = spark.createDataFrame([(batch_id, attempt, versions)], "batch long, attempt string, versions boolean")
    row.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/of={batch_id}")


def analyse_arrivals(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    tables: Callable[[DataFrame], Tables] = arrival_tables,
    mode: str = "append",
) -> StreamingQuery:
    """Process everything that has arrived, each file once, then stop.

    Each attempt at a batch writes folders of its own, one per table; a commit, written last, names the attempt
    that counts.  A batch that fails in between has no commit and is tried again, so readers
    (:func:`read_arrivals`) see each batch whole or not at all, and never twice.
    Where ``lines`` have versions, only the last version of a dataset in a batch is analysed.  ``mode`` is the
    output mode, for streams with state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, attempt = batch.sparkSession, f"a{uuid.uuid4().hex}"
        made: dict[str, DataFrame] = {}
        if set(_VERSION) <= set(batch.columns):
            files = latest_files(batch.select("dataset_id", *_VERSION).distinct())
            batch = batch.join(files, ["dataset_id", *_VERSION], "left_semi").select("dataset_id", "row_idx", "line")
            made["files"] = files
        made.update(tables(batch))
        at_once(spark, lambda name: made[name].write.parquet(f"{out}/{name}/batch={batch_id}/attempt={attempt}"), made)
        _commit(spark, out, batch_id, attempt, "files" in made)

    return (
        lines.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def committed_rows(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of all committed batches, with ``batch`` and ``attempt``."""
    commits = spark.read.parquet(f"{out}/commits").select("batch", "attempt")
    return spark.read.parquet(f"{out}/{name}").join(commits, ["batch", "attempt"], "left_semi")


def read_arrivals(spark: SparkSession, out: str, name: str, latest: bool = True) -> DataFrame:
    """A table of all committed batches; with ``latest`` only of the last version of each dataset.

    Without versions there is one of each dataset.
    """
    rows = committed_rows(spark, out, name)
    if latest and not spark.read.parquet(f"{out}/commits").where("versions").isEmpty():
        newest = latest_files(committed_rows(spark, out, "files").select("dataset_id", *_VERSION, "batch"))
        rows = rows.join(newest.select("dataset_id", "batch"), ["dataset_id", "batch"], "left_semi")
    return rows.drop("batch", "attempt")

