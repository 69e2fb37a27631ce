"""Tracking files: comma-separated, with ``#`` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.numeric import strip
from labspark.sources.delimited import parse_rows
from labspark.operators.ordered import BLOCK_ROWS


def tracking_layouts(lines: DataFrame) -> DataFrame:
    """Header per file: the first line that is not empty after its comment is cut; names trimmed, lower-cased."""
    text = F.when(strip(F.col("line")) != "", F.col("line"))
    headers = lines.groupBy("dataset_id").agg(
        F.min_by(text, F.when(text.isNotNull(), F.col("row_idx"))).alias("header"),
        F.min(F.when(text.isNotNull(), F.col("row_idx"))).alias("header_idx"),
        F.max("row_idx").alias("last_idx"),
    )
    names = F.transform(F.split("header", ","), lambda name: F.lower(strip(name)))
    return headers.withColumns({"delimiter": F.lit(","), "names": names})


def strip_comments(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", "#.*$", ""))


def read_tracking(
    lines: DataFrame, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``(layouts, rows)`` of tracking files; rows carry the lower-cased ``names``."""
    cleaned = strip_comments(lines)
    layouts = tracking_layouts(cleaned)
    return layouts, parse_rows(cleaned, layouts, "names", block_rows=block_rows)
