"""Lists of any length written in parallel and read back in their order.

A list is cut into blocks of consecutive row numbers.  Blocks are written by many tasks; a manifest says how
many rows each has and how many stand before it.  So a row's place in its list needs only its block and its
manifest entry, and a list is never in one task or one cell.  A list as text comes in chunks in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.operators.ordered import BLOCK, BLOCK_ROWS, into_blocks

#: Coordinates of a chunk of text; about two megabytes.
CHUNK_ROWS = 1 << 16


def with_offsets(blocks: DataFrame, keys: Sequence[str], block: str, n: str = "n") -> DataFrame:
    """``blocks`` with ``offset``: the rows of the list before each block; one row per block is ordered."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def write_ordered(
    rows: DataFrame,
    path: str,
    keys: Sequence[str] = ("dataset_id",),
    row: str = "row_idx",
    fmt: str = "parquet",
    block_rows: int = BLOCK_ROWS,
) -> None:
    """Write ``rows`` below ``path/rows`` and their manifest below ``path/manifest``.

    ``row`` is unique and increasing along a list.  The manifest is counted from what was written and comes
    last; without it there is nothing to read, so an interrupted write is not taken for a short list.
    Rows without key or number belong to no list and are left out.
    """
    blocked = into_blocks(rows, keys, row, block_rows).sortWithinPartitions(*keys, row)
    _writer(blocked, fmt).save(f"{path}/rows")
    written = rows.sparkSession.read.format(fmt).schema(blocked.schema).load(f"{path}/rows")
    blocks = written.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last"))
    with_offsets(blocks, keys, BLOCK).write.mode("overwrite").parquet(f"{path}/manifest")


def _writer(df: DataFrame, fmt: str):
    writer = df.write.mode("overwrite").format(fmt)
    return writer.option("ignoreNullFields", "false") if fmt == "json" else writer


def list_sizes(spark: SparkSession, path: str, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """``keys, n``: the length of every written list, from the manifest alone."""
    return spark.read.parquet(f"{path}/manifest").groupBy(*keys).agg(F.sum("n").alias("n"))


def read_ordered(
    spark: SparkSession,
    path: str,
    schema: str,
    keys: Sequence[str] = ("dataset_id",),
    row: str = "row_idx",
    fmt: str = "parquet",
) -> DataFrame:
    """The rows written by :func:`write_ordered` with ``position``, their 0-based place in the list.

    ``schema`` are the columns of the rows as they were given.
    """
    rows = spark.read.format(fmt).schema(f"{schema}, {BLOCK} long").load(f"{path}/rows")
    manifest = spark.read.parquet(f"{path}/manifest").select(*keys, BLOCK, "offset")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(row)
    placed = rows.join(manifest, [*keys, BLOCK]).withColumn("position", F.row_number().over(inside) - 1 + F.col("offset"))
    return placed.drop(BLOCK, "offset")


def coordinate_chunks(
    points: DataFrame,
    x: Column,
    y: Column,
    keys: Sequence[str] = ("dataset_id",),
    row: str = "row_idx",
    digits: int = 6,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``keys, chunk, n, offset, coordinates``: the points of a list as text ``(x,y) (x,y)``, in chunks.

    The chunks of a list in their order, with a blank between them, are the whole text; a chunk holds at most
    ``chunk_rows`` points.  Points without a finite x and y are left out.
    """
    chunk = F.expr(f"`{row}` div {int(chunk_rows)}L")
    kept = points.select(*keys, F.col(row).alias("_row"), chunk.alias("chunk"), x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    listed = kept.filter("abs(_x) < double('Infinity') and abs(_y) < double('Infinity')").groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_row", "_x", "_y"))).alias("_points")
    )
    text = F.transform("_points", lambda p: F.format_string(f"(%.{digits}f,%.{digits}f)", p["_x"], p["_y"]))
    return with_offsets(listed, keys, "chunk").select(*keys, "chunk", "n", "offset", F.array_join(text, " ").alias("coordinates"))
