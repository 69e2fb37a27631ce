"""Catalog tables, protocol corpora and generation payloads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labspark.operators.ordered import BLOCK_ROWS

TAXA_COLUMNS = [
    "taxon_id",
    "scientific_name",
    "german_name",
    "rank",
    "status",
    "app_scope",
    "family",
    "source_pdf",
]
FEATURE_COLUMNS = [
    "feature_id",
    "taxon_id",
    "organ",
    "feature_group",
    "character",
    "state",
    "diagnostic_weight",
    "visibility_in_photo",
    "source_note",
]


# Commands of bibliography files that open no entry.
NO_ENTRIES = ["string", "comment", "preamble"]


def read_catalog(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """``taxa``, ``features`` and ``release`` below one folder; filters and columns reach the scan."""
    return {name: spark.read.format(fmt).load(f"{root}/{name}") for name in ("taxa", "features", "release")}


def first_release(release: DataFrame) -> DataFrame:
    """One row of the manifest, the first by version and stage."""
    return release.select("version", "release_stage").orderBy("version", "release_stage").limit(1)


def read_protocols(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``docs(doc_id, path, tex)``: one protocol text per file; its folder's whole path is the document's id.

    Files of one folder share its bibliography; ``path`` tells them apart.
    """
    return spark.read.text(paths, wholetext=True).select(
        _folder().alias("doc_id"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("tex"),
    )


def read_bibliographies(spark: SparkSession, paths: str | Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``bib(doc_id, entry_type, key)`` of bibliography files of any size; files of one folder are one bibliography.

    Files are read up to each closing brace, so a large one is split and a key may stand on the line after its
    opening brace.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = spark.read.option("lineSep", "}").text(paths).select(
        _folder().alias("doc_id"),
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") + place).alias("row_idx"),
        F.col("value").alias("part"),
    )
    return bib_entries(parts, block_rows)


def _folder() -> Column:
    return F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1)


def bib_entries(parts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, entry_type, key`` of the entries in ``parts(doc_id, path, row_idx, part)`` of bibliography files.

    A part ends before a closing brace; ``row_idx`` orders the parts of a file.  An entry opens only outside all
    braces, so an ``@`` inside a value is none.  The depth before a part is the number of braces opened and
    closed before it, where a closing brace too many counts for nothing: a running sum less its lowest value.
    Both are taken in blocks of parts and carried over the blocks of a file.  Abbreviations, comments and
    preambles are no entries.
    """
    step = F.length("part") - F.length(F.replace("part", F.lit("{"))) - 1
    file, block = ["doc_id", "path"], ["doc_id", "path", "_part_block"]
    here = Window.partitionBy(*block).orderBy("row_idx")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        parts.withColumn("_part_block", F.expr(f"row_idx div {int(block_rows)}L"))
        .withColumn("step", step.cast("long"))
        .withColumn("sum", F.sum("step").over(here))
        .withColumn("lowest", F.min("sum").over(earlier))
    )
    before = Window.partitionBy(*file).orderBy("_part_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*block)
        .agg(F.sum("step").alias("total"), F.min("sum").alias("low"))
        .withColumn("carried", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("floor", F.coalesce(F.min(F.col("carried") + F.col("low")).over(before), F.lit(0)))
        .select(*block, "carried", "floor")
    )
    sum_before = F.col("carried") + F.col("sum") - F.col("step")
    floor = F.least(F.lit(0), F.col("floor"), F.col("carried") + F.coalesce("lowest", F.lit(0)))
    # Inside a part braces only open, so an entry's brace is the first of its part.
    pattern = r"^[^{]*@(\w+)\s*\{\s*([^,\s{}]+)"
    entries = rows.join(blocks, block).filter(sum_before - floor == 0).select(
        "doc_id", F.lower(F.regexp_extract("part", pattern, 1)).alias("entry_type"), F.regexp_extract("part", pattern, 2).alias("key")
    )
    return entries.filter((F.col("key") != "") & ~F.col("entry_type").isin(NO_ENTRIES))


def variant_type(ddl: str, untyped: str = "VARIANT") -> T.DataType:
    """The type that a schema of variants names; objects are structs, and what is always null is ``untyped``."""

    def spark_names(part: str) -> str:
        part = re.sub(r"(^|: |<)OBJECT<", r"\1STRUCT<", part)
        return re.sub(r"(^|: |<)VOID(?=[,>]|$)", rf"\1{untyped}", part)

    # Only outside quoted names.
    plain = [p if i % 2 else spark_names(p) for i, p in enumerate(ddl.split("`"))]
    kind = T.DataType.fromDDL("v " + "`".join(plain))
    return kind.fields[0].dataType


def payload_schema(payloads: DataFrame, column: str = "payload") -> T.StructType:
    """One schema over all payloads, found by a distributed aggregate; only its text reaches the driver."""
    ddl = payloads.agg(
        F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("ddl")
    ).first()["ddl"]
    parsed = variant_type(ddl, "VOID")
    return parsed if isinstance(parsed, T.StructType) else T.StructType([])
