"""The whole evaluation of pendulum traces as one set of lazily planned tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators import pendulum as p
from labspark.operators.ordered import BLOCK_ROWS
from labspark.functions.propagation import LITERATURE_LATITUDE_DEG
from labspark.operators.report import json_text, write_table
from labspark.operators.roles import tracking_problems, tracking_samples
from labspark.session import cut_lineage
from labspark.sources.tracking import read_tracking

# Decimals of the result per quantity.
_DIGITS = {
    "dt_s": 4,
    "fs_hz": 3,
    "duration_s": 2,
    "duration_min": 2,
    "x_mean": 2,
    "y_mean": 2,
    "ax": 2,
    "ay": 2,
    "ellipticity": 3,
    "period_s": 5,
    "period_error_s": 5,
    "period_std_s": 5,
    "frequency_hz": 6,
    "frequency_error_hz": 6,
    "omega0": 6,
    "omega0_error": 6,
    "length_m": 4,
    "length_error_m": 4,
    "phi0_deg": 4,
    "b_deg_s": 7,
    "b_error": 7,
    "b_h": 4,
    "b_h_error": 4,
    "s_y": 4,
    "r2": 6,
    "sin_phi": 5,
    "phi_exp": 2,
    "delta_phi_ref": 2,
    "abw_deg": 2,
    "abw_sigma": 1,
    "area_mean": 2,
    "area_s": 2,
    "area_cv": 2,
}


@dataclass(frozen=True)
class PendulumRun:
    sampling: DataFrame
    channels: DataFrame
    extent: DataFrame
    periods: DataFrame
    period_stats: DataFrame
    histogram: DataFrame
    segments: DataFrame
    rotation: DataFrame
    residuals: DataFrame
    coordinates: DataFrame
    quality: DataFrame
    results: DataFrame

    def write(self, root: str, fmt: str = "json", names: Sequence[str] | None = None) -> None:
        for name in names or [f.name for f in fields(self)]:
            write_table(getattr(self, name), f"{root}/{name}", fmt)


def evaluate_traces(
    samples: DataFrame,
    keys: Sequence[str] = ("dataset_id",),
    n_segments: int = p.SEGMENTS,
    title: str = "Versuch",
    block_rows: int = BLOCK_ROWS,
    materialise: bool = True,
) -> PendulumRun:
    """Evaluate all traces; with ``materialise`` periods and segments are written once and shared."""
    keep = cut_lineage if materialise else (lambda df: df)
    keys = list(keys)
    sampling = p.sampling_summary(samples, keys, block_rows)
    period_rows = keep(p.periods(samples, keys, block_rows))
    segments = keep(
        p.unwrap_angles(p.segment_axis(samples, keys, n_segments, block_rows=block_rows), keys)
    )
    rotation = keep(p.rotation_fit(segments, keys))
    stats = p.period_stats(period_rows, keys)
    extent = p.trajectory_extent(samples, keys)
    quality = p.tracking_quality(samples, keys)
    coordinates = p.coordinate_export(segments, rotation, keys)
    channels = p.channel_stats(samples, keys)
    return PendulumRun(
        sampling=sampling,
        channels=channels,
        extent=extent,
        periods=period_rows,
        period_stats=stats,
        histogram=p.period_histogram(period_rows, keys, block_rows=block_rows),
        segments=segments,
        rotation=rotation,
        residuals=p.rotation_residuals(segments, rotation, keys),
        coordinates=coordinates,
        quality=quality,
        results=result_rows(
            keys,
            title,
            sampling,
            extent,
            stats,
            rotation,
            quality,
            coordinates,
            _listed(channels, keys, "channel", "channels"),
            _listed(segments, keys, "seg", "segments"),
        ),
    )


def _listed(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """The rows of a trace as one list: its four channels or its segments, whose number is a parameter."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


@dataclass(frozen=True)
class TrackingAnalysis:
    """Tracking files: those that cannot be evaluated, hints, the tables of the others, and one result per file."""

    problems: DataFrame
    run: PendulumRun
    results: DataFrame


def analyse_tracking(
    lines: DataFrame,
    n_segments: int = p.SEGMENTS,
    title: str = "Versuch",
    block_rows: int = BLOCK_ROWS,
    materialise: bool = True,
) -> TrackingAnalysis:
    """From text lines to results: ``results(dataset_id, columns, error, hint, title, results)``.

    A file with an error has no result; one without x or y has statistics of its channels and a hint.
    """
    keep = cut_lineage if materialise else (lambda df: df)
    layouts, rows = read_tracking(lines, block_rows)
    layouts = keep(layouts)
    problems = keep(tracking_problems(layouts, rows))
    failed = problems.filter("error is not null").select("dataset_id")
    samples = tracking_samples(rows).join(failed, "dataset_id", "left_anti")
    run = evaluate_traces(samples, n_segments=n_segments, title=title, block_rows=block_rows, materialise=materialise)
    results = (
        layouts.select("dataset_id", F.col("names").alias("columns"))
        .join(problems, "dataset_id", "left")
        .join(run.results, "dataset_id", "left")
    )
    return TrackingAnalysis(problems, run, results)


def _rounded(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(
        *[
            F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c)
            for c in df.columns
            if c not in keys
        ]
    )


def result_rows(keys: Sequence[str], title: str, sampling: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row per trace: title, rounded results and plot coordinates as JSON (one part per column)."""
    names = ["extent", "periods", "rotation", "quality", "plot", "channel_table", "segment_table"]
    rows = sampling.select(*keys, _rounded(sampling, keys).alias("sampling"))
    for name, part in zip(names, parts, strict=True):
        rows = rows.join(part.select(*keys, _rounded(part, keys).alias(name)), list(keys), "left")
    more = {
        "segment_s": F.round(F.col("rotation.seg_rows") * F.col("sampling.dt_s"), 2),
        "phi_lit": F.lit(LITERATURE_LATITUDE_DEG),
    }
    body = json_text(F.struct("sampling", *names, *[value.alias(name) for name, value in more.items()]))
    return rows.select(*keys, F.lit(title).alias("title"), body.alias("results"))
