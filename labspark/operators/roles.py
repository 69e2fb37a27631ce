"""Binding of column roles by name, and the value pairs read through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.numeric import as_number, finite
from labspark.sources.delimited import ERROR_STRUCTURE

# Patterns searched in lower-cased column names; the first column in file order wins.
ROLE_PATTERNS = {
    "time": [r"^t$", r"time", r"zeit"],
    "angle": [r"angle", r"winkel", r"phi", r"varphi"],
    "frequency": [r"^frequency_hz$", r"^frequency$", r"^frequenz$", r"^f$", r"^f_hz$", r"^hz$"],
    "spacing": [
        r"^peak_spacing_m$",
        r"^peak_spacing$",
        r"^spacing$",
        r"^abstand$",
        r"^maxima_abstand$",
        r"^flammen_abstand$",
        r"^d$",
        r"^d_m$",
    ],
    "x_track": [r"^x$", r"^x_px$", r"x.*pixel", r"center.*x", r"^cx$"],
    "y_track": [r"^y$", r"^y_px$", r"y.*pixel", r"center.*y", r"^cy$"],
}
# Exact column names of tracking files.
TRACKING_ALIASES = {
    "t": ["t", "time", "zeit"],
    "x": ["x", "x_pos", "px_x", "xpos"],
    "y": ["y", "y_pos", "px_y", "ypos"],
    "area": ["area", "flaeche", "size"],
    "valid": ["valid"],
}


def pattern_role(names: Column, patterns: Sequence[str]) -> Column:
    """0-based index of the first column whose lower-cased name matches, else NULL."""
    joined = "|".join(patterns)
    hits = F.transform(names, lambda name: F.lower(name).rlike(joined))
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int") - 1


def alias_role(names: Column, aliases: Sequence[str]) -> Column:
    """0-based index of the first column named by one of the aliases, else NULL."""
    hits = F.transform(names, lambda name: name.isin(list(aliases)))
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int") - 1


def with_roles(layouts: DataFrame) -> DataFrame:
    """Role indices as columns ``role_*``: a projection of the header, no grouping and no join."""
    return layouts.withColumns(
        {f"role_{role}": pattern_role(F.col("names"), p) for role, p in ROLE_PATTERNS.items()}
    )


def with_tracking_roles(layouts: DataFrame) -> DataFrame:
    return layouts.withColumns(
        {f"role_{role}": alias_role(F.col("names"), a) for role, a in TRACKING_ALIASES.items()}
    )


def role_table(layouts: DataFrame) -> DataFrame:
    """Long form ``dataset_id, role, col_idx, column`` of the bound roles."""
    bound = with_roles(layouts)
    entries = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(f"role_{role}").alias("col_idx"))
            for role in ROLE_PATTERNS
        ]
    )
    return (
        bound.select("dataset_id", "names", F.explode(entries).alias("e"))
        .filter("e.col_idx is not null")
        .select("dataset_id", "e.role", "e.col_idx", F.get("names", F.col("e.col_idx")).alias("column"))
    )


def role_value(role: str) -> Column:
    """The row's number in the role's column; NULL if the role is unbound or the cell is no number."""
    return as_number(F.get(F.col("fields"), F.col(f"role_{role}")))


def pair_values(x_role: str, y_role: str, positive: bool = False) -> tuple[Column, Column]:
    """Both numbers of a row where the pair is complete, finite and, if asked, positive; else NULL twice.

    Both roles must be bound to different columns.
    """
    x, y = finite(role_value(x_role)), finite(role_value(y_role))
    keep = (F.col(f"role_{x_role}") != F.col(f"role_{y_role}")) & x.isNotNull() & y.isNotNull()
    if positive:
        keep = keep & (x > 0) & (y > 0)
    return F.when(keep, x), F.when(keep, y)


def pairs(rows: DataFrame, x_role: str, y_role: str, positive: bool = False) -> DataFrame:
    """``dataset_id, row_idx, x, y`` of the complete (and positive) pairs."""
    x, y = pair_values(x_role, y_role, positive)
    bound = F.col(f"role_{x_role}").isNotNull() & F.col(f"role_{y_role}").isNotNull()
    values = rows.filter(bound).select("dataset_id", "row_idx", x.alias("x"), y.alias("y"))
    return values.filter("x is not null and y is not null")


def tracking_samples(rows: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """``samples(dataset_id, row_idx, t, x, y, area)`` of the valid rows.

    ``rows`` must carry ``names``; where a file has a column ``valid``, only rows with the value 1 stay.
    Infinite cells count as missing.  Files with a row that is longer than the header or has an open quote
    are reported by :func:`tracking_problems` and yield no sample.
    """
    broken = rows.filter(is_broken()).select("dataset_id").distinct()
    bound = with_tracking_roles(rows.join(broken, "dataset_id", "left_anti"))
    valid = F.col("role_valid").isNull() | (role_value("valid") == 1)
    return bound.filter(valid).select(
        "dataset_id", "row_idx", *[finite(role_value(role)).alias(role) for role in ("t", "x", "y", "area")]
    )


def is_broken() -> Column:
    """Whether a parsed row is longer than its header or leaves a quote open."""
    return (F.col("n_fields") > F.col("_width")) | F.col("malformed")


def tracking_problems(layouts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Files without a time column or with a broken row (error), or without x or y (statistics only)."""
    bound = with_tracking_roles(layouts)
    if rows is not None:
        broken = rows.groupBy("dataset_id").agg(F.max(is_broken()).alias("_broken"))
        bound = bound.join(broken, "dataset_id", "left")
    else:
        bound = bound.withColumn("_broken", F.lit(False))
    broken = F.coalesce("_broken", F.lit(False))
    no_time = F.col("role_t").isNull()
    no_track = F.col("role_x").isNull() | F.col("role_y").isNull()
    return bound.filter(broken | no_time | no_track).select(
        "dataset_id",
        F.when(broken, ERROR_STRUCTURE)
        .when(no_time, "Keine Zeitspalte (t/time/zeit) gefunden")
        .alias("error"),
        F.when(~broken & ~no_time, "Nur Statistik verfuegbar (x/y-Spalten fehlen)").alias("hint"),
    )
