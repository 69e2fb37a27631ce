"""The whole analysis of measurement files as one set of tables, planned when they are asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators import report
from labspark.operators.ordered import BLOCK_ROWS
from labspark.operators.physics import (
    angular_from_sums,
    latitude_from_rate,
    physics_sums,
    resonance_from_sums,
    resonance_points,
)
from labspark.operators.profile import (
    column_profile,
    dataset_overview,
    missing_summary,
    numeric_stats,
)
from labspark.operators.roles import ROLE_PATTERNS, pairs, role_table, with_roles
from labspark.session import cut_lineage
from labspark.sinks.ordered import coordinate_chunks, write_ordered
from labspark.sources.delimited import accepted, column_names, detect, errors, parse_rows, to_cells


class Analysis:
    """Tables keyed by ``dataset_id``, each planned when it is first asked for.

    What several tables build on (layouts, and results of one row per file or column) is written to the
    checkpoint folder once, with ``materialise``; a table that nobody asks for costs nothing.
    Reports never nest lists over rows: ``resonance_points`` and the coordinates hold them, and the report
    names these tables with their number of rows.
    """

    TABLES = (
        "layouts errors statistics profile missing overview resonance_points tube_coordinates angle_coordinates "
        "resonance regression latitude items preview_blocks summary reports"
    ).split()

    def __init__(self, lines: DataFrame, metadata: DataFrame | None, block_rows: int, materialise: bool):
        if metadata is None:
            metadata = lines.sparkSession.createDataFrame([], "dataset_id string, metadata map<string,string>")
        self._lines, self._metadata, self._block_rows = lines, metadata, block_rows
        self._keep = cut_lineage if materialise else (lambda df: df)

    @cached_property
    def layouts(self) -> DataFrame:
        return self._keep(detect(self._lines, self._block_rows))

    @cached_property
    def errors(self) -> DataFrame:
        return errors(self.layouts)

    @cached_property
    def _names(self) -> DataFrame:
        return column_names(self.layouts)

    @cached_property
    def _rows(self) -> DataFrame:
        return measurement_rows(self._lines, self.layouts, self._block_rows)

    def _named(self, df: DataFrame) -> DataFrame:
        return df.join(self._names, ["dataset_id", "col_idx"])

    @cached_property
    def statistics(self) -> DataFrame:
        return self._keep(self._named(numeric_stats(to_cells(self._rows))))

    @cached_property
    def _profile(self) -> DataFrame:
        return self._keep(column_profile(to_cells(self._rows)))

    @cached_property
    def profile(self) -> DataFrame:
        return self._named(self._profile)

    @cached_property
    def missing(self) -> DataFrame:
        return missing_summary(self._profile, self._names)

    @cached_property
    def overview(self) -> DataFrame:
        return dataset_overview(self._profile, self._names)

    @cached_property
    def resonance_points(self) -> DataFrame:
        return resonance_points(pairs(self._rows, "frequency", "spacing", positive=True))

    @cached_property
    def tube_coordinates(self) -> DataFrame:
        return coordinate_chunks(self.resonance_points, F.col("inverse_frequency_s"), F.col("peak_spacing_m"), digits=9)

    @cached_property
    def angle_coordinates(self) -> DataFrame:
        return coordinate_chunks(pairs(self._rows, "time", "angle"), F.col("x"), F.col("y"))

    @cached_property
    def _sums(self) -> DataFrame:
        """One row per file; both fits are made of it."""
        return self._keep(physics_sums(self._rows))

    @cached_property
    def resonance(self) -> DataFrame:
        return resonance_from_sums(self._sums)

    @cached_property
    def regression(self) -> DataFrame:
        return angular_from_sums(self._sums)

    @cached_property
    def latitude(self) -> DataFrame:
        return latitude_from_rate(self.regression, self._metadata)

    @cached_property
    def items(self) -> DataFrame:
        return self._keep(
            analysis_items(
                self.layouts,
                self.profile,
                self.statistics,
                self.missing,
                self.overview,
                self.resonance,
                self.regression,
                self.latitude,
                self._metadata,
            )
        )

    @cached_property
    def preview_blocks(self) -> DataFrame:
        return report.preview_blocks(self.items)

    @cached_property
    def summary(self) -> DataFrame:
        return report.generation_summary(self.overview)

    @cached_property
    def reports(self) -> DataFrame:
        return report.nested_report(self.overview, self.items, self.preview_blocks, self.summary)

    @cached_property
    def warnings(self) -> DataFrame:
        """The items of the array ``warnings``, without the rest of the analysis."""
        flags = analysis_flags(self.layouts, self.resonance, self.regression, self._metadata)
        return report.column_warnings(self.profile).unionByName(report.dataset_warnings(flags))

    def write(self, root: str, fmt: str = "parquet", names: Sequence[str] | None = None) -> None:
        """Write the tables below ``root``; the points of a file keep their order by a manifest."""
        for name in names or self.TABLES:
            if name == "resonance_points":
                write_ordered(self.resonance_points, f"{root}/{name}", fmt=fmt)
            else:
                by = ["source_array"] if name == "items" else []
                report.write_table(getattr(self, name), f"{root}/{name}", fmt, by)


def measurement_rows(lines: DataFrame, layouts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Parsed rows of the accepted files, with the role indices on every row."""
    roles = [f"role_{role}" for role in ROLE_PATTERNS]
    return parse_rows(lines, with_roles(accepted(layouts)), *roles, block_rows=block_rows)


def analyse(
    lines: DataFrame, metadata: DataFrame | None = None, block_rows: int = BLOCK_ROWS, materialise: bool = True
) -> Analysis:
    """The analysis of all files of ``lines``; ``metadata(dataset_id, metadata MAP<STRING,STRING>)`` is optional."""
    return Analysis(lines, metadata, block_rows, materialise)


def analysis_flags(
    layouts: DataFrame, tube: DataFrame, regression: DataFrame, metadata: DataFrame
) -> DataFrame:
    """What is known about each accepted file, one row per file."""
    bound = with_roles(accepted(layouts))
    has = {role: F.col(f"role_{role}").isNotNull() for role in ROLE_PATTERNS}
    flags = bound.select(
        "dataset_id",
        (has["frequency"] & has["spacing"]).alias("has_tube"),
        (has["time"] | has["angle"]).alias("names_time_or_angle"),
        (has["x_track"] & has["y_track"]).alias("has_xy"),
    )
    tube_n = tube.select(
        "dataset_id", F.col("n").alias("tube_pairs"), F.col("slope").isNotNull().alias("tube_fitted")
    )
    fitted = regression.select("dataset_id", F.lit(True).alias("has_regression"))
    joined = (
        flags.join(tube_n, "dataset_id", "left")
        .join(fitted, "dataset_id", "left")
        .join(metadata.select("dataset_id", "metadata"), "dataset_id", "left")
    )
    defaults = {"tube_pairs": 0, "tube_fitted": False, "has_regression": False}
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def analysis_items(
    layouts: DataFrame,
    profile: DataFrame,
    statistics: DataFrame,
    missing: DataFrame,
    overview: DataFrame,
    tube: DataFrame,
    regression: DataFrame,
    latitude: DataFrame,
    metadata: DataFrame,
) -> DataFrame:
    """All report items.  Lists over columns are nested, lists over rows stay in their own table."""
    flags = analysis_flags(layouts, tube, regression, metadata)

    def listed(df: DataFrame, *columns: str) -> DataFrame:
        rows = df.groupBy("dataset_id").agg(
            F.array_sort(F.collect_list(F.struct("col_idx", F.struct(*columns).alias("v")))).alias("_l")
        )
        return rows.select("dataset_id", F.transform("_l", lambda e: e["v"]).alias("_rows"))

    stats_rows = listed(
        statistics,
        "column",
        "n",
        "mean",
        F.col("sample_std").alias("sample_std_ddof1"),
        "sem",
        "min",
        "max",
    )
    profile_rows = listed(
        profile,
        "column",
        "inferred_type",
        "non_missing_count",
        "missing_count",
        "numeric_count",
        "text_count",
        "unique_count",
        "is_constant",
    )
    columns = role_table(accepted(layouts)).groupBy("dataset_id").agg(
        *[
            F.max(F.when(F.col("role") == role, F.col("column"))).alias(role)
            for role in ("time", "angle", "frequency", "spacing")
        ]
    )
    computed = tube.filter("n >= 2").join(columns, "dataset_id")
    fitted = computed.filter("slope is not null")
    angular = regression.join(columns, "dataset_id")
    known = flags.filter("has_tube or has_regression or has_xy")
    json = report.json_text

    def named(table: str) -> Column:
        return F.struct(F.lit(table).alias("table"), F.col("n").alias("rows"))

    parts = [
        report.item(
            overview.join(stats_rows, "dataset_id", "left"),
            "raw_statistics",
            F.coalesce(json(F.col("_rows")), F.lit("[]")),
        ),
        report.item(profile_rows, "column_profile", json(F.col("_rows"))),
        report.item(computed, "rubensrohr_sound_speed_table", json(named("resonance_points"))),
        report.item(
            fitted,
            "rubensrohr_inverse_frequency_plot",
            json(
                F.struct(
                    named("tube_coordinates").alias("coordinates"),
                    F.lit("inverse_frequency_s").alias("x"),
                    F.lit("peak_spacing_m").alias("y"),
                )
            ),
        ),
        report.item(
            angular,
            "angle_time_plot",
            json(
                F.struct(
                    F.col("time").alias("x_col"),
                    F.col("angle").alias("y_col"),
                    "slope",
                    named("angle_coordinates").alias("coordinates"),
                )
            ),
        ),
        report.item(
            missing,
            "missing_values_summary",
            json(F.struct("total_missing_values", "missing_values_per_column")),
            include=F.col("total_missing_values") > 0,
        ),
        report.item(
            overview,
            "dataset_overview",
            json(
                F.struct(
                    F.col("row_count").alias("rows"),
                    F.col("column_count").alias("columns"),
                    "missing_values",
                )
            ),
        ),
        report.item(
            computed,
            "rubensrohr_sound_speed_result",
            json(
                F.struct(
                    "n",
                    F.col("speed_mean").alias("mean_sound_speed_m_s"),
                    F.col("speed_sample_std").alias("sample_std_ddof1_m_s"),
                    F.col("speed_sem").alias("sem_m_s"),
                    F.col("speed_min").alias("min_sound_speed_m_s"),
                    F.col("speed_max").alias("max_sound_speed_m_s"),
                    F.struct(
                        F.col("frequency").alias("frequency_Hz"), F.col("spacing").alias("peak_spacing_m")
                    ).alias("source_columns"),
                )
            ),
        ),
        report.item(
            latitude,
            "latitude_result",
            json(
                F.struct(
                    "not_computable",
                    "reason",
                    "omega_mess_rad_s",
                    "ratio",
                    "latitude_deg",
                    "correction_factor_used",
                )
            ),
        ),
        report.item(
            fitted,
            "rubensrohr_inverse_frequency_regression",
            json(
                F.struct(
                    F.lit("peak_spacing_m = slope * (1 / frequency_Hz) + intercept").alias("model"),
                    "n",
                    "slope",
                    "intercept",
                    "slope_stderr",
                    "intercept_stderr",
                    "c_regression_m_s",
                    "c_regression_stderr_m_s",
                    "r_squared",
                    "p_value",
                    named("tube_coordinates").alias("coordinates"),
                )
            ),
        ),
        report.item(
            angular,
            "angular_regression",
            json(
                F.struct(
                    F.col("time").alias("x_column"),
                    F.col("angle").alias("y_column"),
                    "n",
                    "slope",
                    "intercept",
                    "r_value",
                    "r_squared",
                    "p_value",
                    F.col("slope_stderr").alias("stderr"),
                )
            ),
        ),
        report.item(
            known,
            "gaussian_error_template",
            json(F.struct(F.lit(report.ERROR_FORMULA).alias("latex"))),
        ),
        report.column_warnings(profile),
        report.dataset_warnings(flags),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
