"""Column statistics and profiles of ``cells(dataset_id, row_idx, col_idx, raw, num)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.numeric import as_number, finite, is_nonfinite, plain_number, ratio

_COLUMN = ["dataset_id", "col_idx"]


def moments(value: Column) -> dict[str, Column]:
    """n, mean, sample deviation (NULL below two values), standard error, extremes."""
    deviation = F.stddev_samp(value)
    return {
        "n": F.count(value),
        "mean": F.avg(value),
        "sample_std": deviation,
        "sem": ratio(deviation, F.sqrt(F.count(value))),
        "min": F.min(value),
        "max": F.max(value),
    }


def numeric_stats(cells: DataFrame) -> DataFrame:
    """Statistics of every column with at least one number; infinite cells are counted, not averaged."""
    stats = {name: agg.alias(name) for name, agg in moments(finite(F.col("num"))).items()}
    return (
        cells.filter("num is not null")
        .groupBy(*_COLUMN)
        .agg(*stats.values(), F.count_if(is_nonfinite(F.col("num"))).alias("nonfinite_count"))
    )


def wide_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same statistics for columns of a typed table: one pass over the wide rows, unpivoted afterwards."""
    per_column = [
        F.struct(*[agg.alias(name) for name, agg in moments(finite(F.col(c))).items()]).alias(c)
        for c in columns
    ]
    wide = df.groupBy(*keys).agg(*per_column)
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])
    return wide.select(*keys, F.explode(named).alias("e")).select(*keys, "e.column", "e.s.*")


def column_profile(cells: DataFrame) -> DataFrame:
    """Counts, distinct values, constancy and inferred type per column.

    Values are first counted per distinct text (combined before the shuffle), so neither a repeated value
    nor a long column meets in one task, and number patterns are tested once per distinct text.
    Distinct values are numbers where every cell is a number as written, else texts.
    """
    per_text = cells.groupBy(*_COLUMN, "raw").agg(F.count(F.lit(1)).alias("c"))
    plain, number = plain_number(F.col("raw")), as_number(F.col("raw"))
    per_value = per_text.groupBy(
        *_COLUMN, plain.alias("plain"), F.when(plain.isNull(), F.col("raw")).alias("other")
    ).agg(
        F.sum(F.when(F.col("raw").isNotNull(), F.col("c"))).alias("present"),
        F.sum(F.when(F.col("raw").isNull(), F.col("c"))).alias("missing"),
        F.sum(F.when(number.isNotNull(), F.col("c"))).alias("numeric"),
        F.count("raw").alias("texts"),
    )
    total = {
        name: F.coalesce(F.sum(source), F.lit(0)).alias(name)
        for name, source in {
            "non_missing_count": "present",
            "missing_count": "missing",
            "numeric_count": "numeric",
        }.items()
    }
    counts = per_value.groupBy(*_COLUMN).agg(
        *total.values(),
        F.sum("texts").alias("_texts"),
        F.count("plain").alias("_values"),
        F.coalesce(F.sum(F.when(F.col("plain").isNull(), F.col("present"))), F.lit(0)).alias("_not_plain"),
    )
    present, numeric = F.col("non_missing_count"), F.col("numeric_count")
    unique = F.when(F.col("_not_plain") == 0, F.col("_values")).otherwise(F.col("_texts"))
    return counts.select(
        *_COLUMN,
        F.when(present == 0, "empty")
        .when(numeric == present, "numeric")
        .when(numeric == 0, "text")
        .otherwise("mixed")
        .alias("inferred_type"),
        "non_missing_count",
        "missing_count",
        "numeric_count",
        (present - numeric).alias("text_count"),
        unique.alias("unique_count"),
        ((present > 0) & (unique == 1)).alias("is_constant"),
    )


def missing_per_column(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*_COLUMN).agg(F.count_if(F.col("raw").isNull()).alias("missing_count"))


def counts_per_column(cells: DataFrame) -> DataFrame:
    """The cell counts of :func:`column_profile` alone, which need no distinct values."""
    return cells.groupBy(*_COLUMN).agg(
        F.count("raw").alias("non_missing_count"),
        F.count_if(F.col("raw").isNull()).alias("missing_count"),
        F.count_if(as_number(F.col("raw")).isNotNull()).alias("numeric_count"),
    )


def missing_summary(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Total and per-column map from ``missing_count`` per column, of a profile or of the above.

    A map has as many entries as the file's header has columns.
    """
    entry = F.struct("col_idx", "column", "missing_count")
    return (
        counts.select(*_COLUMN, "missing_count")
        .join(names, _COLUMN)
        .groupBy("dataset_id")
        .agg(
            F.sum("missing_count").alias("total_missing_values"),
            F.array_sort(F.collect_list(entry)).alias("_columns"),
        )
        .select(
            "dataset_id",
            "total_missing_values",
            F.map_from_entries(
                F.transform("_columns", lambda e: F.struct(e["column"], e["missing_count"]))
            ).alias("missing_values_per_column"),
        )
    )


def dataset_overview(profile: DataFrame, names: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and detected numeric columns, from a profile or its counts."""
    entry = F.when(F.col("numeric_count") > 0, F.struct("col_idx", "column"))
    return (
        profile.join(names, _COLUMN)
        .groupBy("dataset_id")
        .agg(
            F.max(F.col("non_missing_count") + F.col("missing_count")).alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            F.sum("missing_count").alias("missing_values"),
            F.array_sort(F.collect_list(entry)).alias("_numeric"),
        )
        .withColumn("detected_numeric_columns", F.transform("_numeric", lambda e: e["column"]))
        .drop("_numeric")
    )
