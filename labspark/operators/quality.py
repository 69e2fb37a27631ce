"""Catalog data quality: invariants, completeness, dangling references, scope tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.catalog import HIDDEN_STATUSES, name_matches, visible

# Ranks that must have features once active.
RANKS_WITH_FEATURES = ["species", "genus", "hybrid"]
ACTIVE_STATUS = "active"
REVIEW_STATUS = "review"


def active_without_features(taxa: DataFrame, features: DataFrame) -> DataFrame:
    """Active species, genera and hybrids without any feature (should be none)."""
    direct = taxa.filter((F.col("status") == ACTIVE_STATUS) & F.col("rank").isin(RANKS_WITH_FEATURES))
    # one row per taxon before the join: a taxon owning most features costs one row, not a hot key
    owners = features.select("taxon_id").distinct()
    return direct.join(owners, "taxon_id", "left_anti")


def dangling_features(taxa: DataFrame, features: DataFrame) -> DataFrame:
    """Per unknown ``taxon_id``: the number of features that refer to it."""
    referred = features.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n_features"))
    return referred.join(taxa.select("taxon_id"), "taxon_id", "left_anti")


def _is_empty(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def catalog_expectations(
    taxa: DataFrame, release: DataFrame, query: str, excluded_ids: Sequence[str] = ()
) -> DataFrame:
    """``name, passed, observed`` of the catalog's invariants for one search text, in one pass over the taxa."""
    match = name_matches(query) if query.strip() else F.lit(True)
    hidden = F.col("status").isin(HIDDEN_STATUSES)
    counts = taxa.agg(
        F.count_if(match & visible(False)).alias("standard"),
        F.count_if(match & visible(True)).alias("with_stubs"),
        F.count_if(hidden & visible(True)).alias("hidden_found"),
        F.count_if(F.col("taxon_id").isin(list(excluded_ids)) & visible(False)).alias("excluded_found"),
    )
    named = release.agg(
        F.count_if(_is_empty("version") | _is_empty("release_stage")).alias("empty_release"),
        F.count(F.lit(1)).alias("releases"),
    )
    checks = counts.select(
        F.array(
            _check("standard_search_finds_taxa", F.col("standard") > 0, "standard"),
            _check("stub_search_finds_no_less", F.col("with_stubs") >= F.col("standard"), "with_stubs"),
            _check("hidden_statuses_not_found", F.col("hidden_found") == 0, "hidden_found"),
            _check("excluded_taxa_not_found", F.col("excluded_found") == 0, "excluded_found"),
        ).alias("checks")
    ).unionByName(
        named.select(
            F.array(
                _check(
                    "release_fields_present",
                    (F.col("releases") > 0) & (F.col("empty_release") == 0),
                    "empty_release",
                )
            ).alias("checks")
        )
    )
    return checks.select(F.explode("checks").alias("c")).select("c.*")


def _check(name: str, passed: Column, observed: str) -> Column:
    return F.struct(
        F.lit(name).alias("name"), passed.alias("passed"), F.col(observed).alias("observed")
    )


def completeness(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and rows without text per column, by group: one pass, unpivoted afterwards."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(_is_empty(c)).alias(f"_empty_{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_empty_{i}").alias("n_empty"))
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*keys, "n_rows", F.explode(entries).alias("e")).select(
        *keys, "n_rows", "e.*"
    )


def awaiting_review(taxa: DataFrame) -> DataFrame:
    return taxa.filter(F.col("status") == REVIEW_STATUS)


def scope_tags(df: DataFrame, column: str = "app_scope", separator: str = "|") -> DataFrame:
    """Rows per tag of a multi-valued text column; tags are combined before the shuffle."""
    pattern = "[" + ("\\" + separator if separator in "\\^]-" else separator) + "]"
    tags = df.select(F.explode(F.split(column, pattern)).alias("tag"))
    return tags.filter(F.trim("tag") != "").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
