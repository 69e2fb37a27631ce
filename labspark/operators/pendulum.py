"""Pendulum traces: sampling, periods, rotation of the swing plane.

``samples(dataset_id, row_idx, t, x, y, area)`` in file order.  See ``ordered`` for how the order inside a
dataset is used without gathering the dataset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.functions.numeric import ratio
from labspark.functions.propagation import (
    angular_frequency_error,
    frequency_error,
    pendulum_length,
    pendulum_length_error,
    per_second_to_per_hour,
    seconds_to_minutes,
)
from labspark.functions.regression import linear_fit
from labspark.operators.ordered import BLOCK, BLOCK_ROWS, annotate, attach, belongs, exact_median, into_blocks, with_block
from labspark.operators.physics import latitude_with_error
from labspark.operators.profile import moments, wide_stats

KEY = ["dataset_id"]
CHANNELS = ["t", "x", "y", "area"]
SEGMENTS = 30
PERIOD_BINS = 20
MIN_PERIODS = 3


def unplaced_rows(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``n_dropped``: rows without key or place, which no evaluation takes."""
    return samples.agg(F.count_if(~belongs(keys)).alias("n_dropped"))


def successive_difference(
    samples: DataFrame, keys: Sequence[str] = KEY, column: str = "t", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows from the second on with ``dt``, the difference of ``column`` to the row before."""
    blocked = into_blocks(samples.select(*keys, "row_idx", column), keys, block_rows=block_rows)
    stepped = annotate(blocked, keys, previous={"_previous": column})
    return stepped.withColumn("dt", F.col(column) - F.col("_previous")).drop("_previous").filter(
        "dt is not null"
    )


def sampling_summary(
    samples: DataFrame, keys: Sequence[str] = KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Row count, exact median time step, sampling rate and total duration."""
    steps = successive_difference(samples, keys, "t", block_rows)
    median = exact_median(steps, keys, "dt", "dt_s")
    span = samples.filter(belongs(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max_by("t", "row_idx") - F.min_by("t", "row_idx")).alias("duration_s"),
    )
    return span.join(median, list(keys), "left").select(
        *keys,
        "n",
        "dt_s",
        ratio(F.lit(1.0), F.col("dt_s")).alias("fs_hz"),
        "duration_s",
        seconds_to_minutes(F.col("duration_s")).alias("duration_min"),
    )


def channel_stats(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean, deviation, standard error and extremes of each channel that has values."""
    return wide_stats(samples.filter(belongs(keys)), keys, CHANNELS).filter("n > 0").withColumnRenamed("column", "channel")


def trajectory_extent(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    half = {c: (F.max(c) - F.min(c)) / 2 for c in ("x", "y")}
    return samples.filter(belongs(keys)).groupBy(*keys).agg(
        F.avg("x").alias("x_mean"),
        F.avg("y").alias("y_mean"),
        half["x"].alias("ax"),
        half["y"].alias("ay"),
    ).withColumn("ellipticity", F.when(F.col("ax") > 0, F.col("ay") / F.col("ax")))


def tracking_quality(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    stats = samples.filter(belongs(keys)).groupBy(*keys).agg(
        F.avg("area").alias("area_mean"), F.stddev_samp("area").alias("area_s")
    )
    return stats.filter("area_mean is not null").withColumn(
        "area_cv", ratio(F.col("area_s"), F.col("area_mean")) * 100
    )


def _blocked_crossings(samples: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    track = samples.select(*keys, "row_idx", "t", "x").filter("t is not null and x is not null")
    rows = annotate(
        into_blocks(track, keys, block_rows=block_rows),
        keys,
        following={"_t_next": "t", "_x_next": "x"},
        totals={"_x_sum": F.col("x"), "_x_count": F.lit(1)},
    )
    mean = F.col("_x_sum") / F.col("_x_count")
    here, there = F.col("x") - mean, F.col("_x_next") - mean
    # A crossing needs here < 0 <= there, so the divisor is never zero.
    instant = F.col("t") - here / (there - here) * (F.col("_t_next") - F.col("t"))
    return rows.filter((here < 0) & (there >= 0)).select(
        *keys, BLOCK, "row_idx", instant.alias("t_cross")
    )


def zero_crossings(
    samples: DataFrame, keys: Sequence[str] = KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Interpolated times at which x rises through its mean; ``row_idx`` is the row before the crossing."""
    return _blocked_crossings(samples, keys, block_rows).drop(BLOCK)


def periods(
    samples: DataFrame, keys: Sequence[str] = KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Differences of consecutive crossings; the crossings keep the partitioning of the rows."""
    crossings = _blocked_crossings(samples, keys, block_rows)
    return (
        annotate(crossings, keys, previous={"_before": "t_cross"})
        .filter("_before is not null")
        .select(*keys, "row_idx", (F.col("t_cross") - F.col("_before")).alias("period"))
    )


def period_stats(period_rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean period with errors, frequencies and pendulum length; at least three periods are required."""
    stats = {k: v for k, v in moments(F.col("period")).items() if k in ("n", "mean", "sample_std", "sem")}
    summary = period_rows.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    period, error = F.col("mean"), F.col("sem")
    return summary.filter(F.col("n") >= MIN_PERIODS).select(
        *keys,
        F.col("n").alias("n_periods"),
        period.alias("period_s"),
        F.col("sample_std").alias("period_std_s"),
        error.alias("period_error_s"),
        ratio(F.lit(1.0), period).alias("frequency_hz"),
        frequency_error(period, error).alias("frequency_error_hz"),
        ratio(F.lit(2 * math.pi), period).alias("omega0"),
        angular_frequency_error(period, error).alias("omega0_error"),
        pendulum_length(period).alias("length_m"),
        pendulum_length_error(period, error).alias("length_error_m"),
    )


def period_histogram(
    period_rows: DataFrame,
    keys: Sequence[str] = KEY,
    bins: int = PERIOD_BINS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Equal-width bins between the shortest and longest period; the last bin is closed.

    Periods that are all equal get the unit-wide range around the value.
    """
    extremes = period_rows.groupBy(*keys).agg(
        F.min("period").alias("lo"), F.max("period").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    flat = F.col("lo") == F.col("hi")
    spread = extremes.filter(F.col("n") >= MIN_PERIODS).select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = F.col("hi") - F.col("lo")
    position = F.floor((F.col("period") - F.col("lo")) / width * bins)
    blocked = into_blocks(period_rows.select(*keys, "row_idx", "period"), keys, block_rows=block_rows)
    return (
        attach(blocked, keys, spread)
        .groupBy(*keys, "lo", "hi", F.least(position, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "bin", (F.col("lo") + width / bins * F.col("bin")).alias("bin_start"), "n")
    )


def segment_axis(
    samples: DataFrame,
    keys: Sequence[str] = KEY,
    n_segments: int = SEGMENTS,
    consistent: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Principal-axis angle of equally long row segments; rows beyond the last full segment are ignored.

    The variances are sample variances while the covariance divides by n; ``consistent`` divides
    both by n-1.  Datasets with fewer rows than segments give no row.
    """
    track = samples.select(*keys, "row_idx", "t", "x", "y")
    rows = annotate(
        into_blocks(track, keys, block_rows=block_rows),
        keys,
        position="_rn",
        totals={"_n": F.lit(1)},
        unshuffled=with_block(samples.select(*keys, "row_idx"), keys, block_rows=block_rows),
    )
    size = F.expr(f"_n div {int(n_segments)}")
    placed = (
        rows.withColumn("_size", size)
        .filter(F.col("_size") > 0)
        .withColumn("seg", F.expr("_rn div _size"))
        .filter(F.col("seg") < n_segments)
        .withColumn("_mid", F.expr("_rn % _size = _size div 2"))
    )
    covariance = F.covar_samp("x", "y") if consistent else F.covar_pop("x", "y")
    segments = placed.groupBy(*keys, "seg", F.col("_size").alias("seg_rows")).agg(
        F.max(F.when(F.col("_mid"), F.col("t"))).alias("t_mid"),
        F.var_samp("x").alias("_sxx"),
        F.var_samp("y").alias("_syy"),
        covariance.alias("_sxy"),
    )
    angle = F.degrees(F.atan2(F.col("_sxy") * 2, F.col("_sxx") - F.col("_syy"))) / 2
    return segments.select(*keys, "seg", "seg_rows", "t_mid", angle.alias("phi")).filter(
        "phi is not null and not isnan(phi) and t_mid is not null"
    )


def unwrap_angles(
    segments: DataFrame, keys: Sequence[str] = KEY, order: str = "seg", angle: str = "phi"
) -> DataFrame:
    """Add multiples of 180 degrees so that successive angles differ by at most 90.

    A dataset has as many rows here as it has segments, which is a parameter, not a data size.
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    step = F.col(angle) - F.lag(angle).over(ordered)
    turn = F.when(step > 90, -180.0).when(step < -90, 180.0).otherwise(0.0)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return (
        segments.withColumn("_turn", turn)
        .withColumn(angle, F.col(angle) + F.sum("_turn").over(upto))
        .drop("_turn")
    )


def rotation_fit(segments: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Straight line through the unwrapped segment angles, with rate per hour and latitude."""
    fit = linear_fit(segments, keys, "t_mid", "phi", keep=[F.max("seg_rows").alias("seg_rows")])
    rate, error = F.col("slope"), F.col("slope_stderr")
    spread = F.sqrt(F.col("residual_sum_squares") / F.greatest(F.col("n") - 2, F.lit(1)))
    fitted = fit.filter("slope is not null").select(
        *keys,
        F.col("n").alias("n_seg"),
        "seg_rows",
        F.col("intercept").alias("phi0_deg"),
        F.col("intercept_stderr").alias("phi0_error"),
        rate.alias("b_deg_s"),
        error.alias("b_error"),
        per_second_to_per_hour(rate).alias("b_h"),
        per_second_to_per_hour(error).alias("b_h_error"),
        F.col("r_squared").alias("r2"),
        spread.alias("s_y"),
    )
    return fitted.withColumns(latitude_with_error(F.col("b_h"), F.col("b_h_error")))


def rotation_residuals(
    segments: DataFrame, fit: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    line = fit.select(*keys, "phi0_deg", "b_deg_s")
    return segments.join(line, list(keys)).select(
        *keys,
        "seg",
        "t_mid",
        "phi",
        (F.col("phi") - (F.col("phi0_deg") + F.col("b_deg_s") * F.col("t_mid"))).alias("residual"),
    )


def coordinate_export(
    segments: DataFrame, fit: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Plot coordinates and the fit as text; one list entry per segment."""
    points = segments.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seg", "t_mid", "phi"))).alias("_points")
    )
    text = F.array_join(
        F.transform("_points", lambda p: F.format_string("(%.1f,%.4f)", p["t_mid"], p["phi"])), " "
    )
    return points.join(fit, list(keys)).select(
        *keys,
        text.alias("coords"),
        F.round("phi0_deg", 4).alias("fit_a"),
        F.round("b_deg_s", 7).alias("fit_b"),
        F.format_string("%.4f + %.7f*x", "phi0_deg", "b_deg_s").alias("fit_formula"),
    )


def slice_angles(
    samples: DataFrame, keys: Sequence[str] = KEY, seconds: float = 120.0
) -> DataFrame:
    """Angle of the line y(x) per time slice: arctangent of the fitted slope."""
    bucket = F.floor(F.col("t") / F.lit(seconds)).alias("slice")
    fits = linear_fit(samples.select(*keys, bucket, "x", "y"), [*keys, "slice"], "x", "y")
    return fits.filter("slope is not null").select(
        *keys, "slice", "n", F.degrees(F.atan("slope")).alias("alpha_deg")
    )
