"""Derived physics of recognised column sets: resonance tube, angular regression, latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.numeric import finite, ratio
from labspark.functions.propagation import (
    EARTH_RATE_DEG_PER_H,
    EARTH_RATE_RAD_PER_S,
    LITERATURE_LATITUDE_DEG,
)
from labspark.functions.regression import fit_results, fit_sums, with_p_value
from labspark.operators.profile import moments
from labspark.operators.roles import pair_values

# Angle units that allow the slope to be read as an angular velocity.
RADIAN_UNITS = ["rad", "radian", "rad/s"]
# Reasons for a latitude that cannot be computed.
REASON_UNIT = (
    "Breitengrad nicht berechenbar: Winkeleinheit bzw. omega_mess_rad_s wurde nicht explizit bereitgestellt."
)
REASON_RATE = "Breitengrad nicht berechenbar: omega_mess_rad_s ist keine endliche Zahl."
REASON_DOMAIN = (
    "Breitengrad nicht berechenbar: omega_mess / Omega_Erde liegt außerhalb des Definitionsbereichs von arcsin."
)


def resonance_points(pairs: DataFrame) -> DataFrame:
    """Wavelength, sound speed and inverse frequency of every (frequency x, spacing y) pair."""
    return pairs.select(
        "dataset_id",
        "row_idx",
        F.col("x").alias("frequency_hz"),
        F.col("y").alias("peak_spacing_m"),
        (F.col("y") * 2).alias("wavelength_m"),
        (F.col("x") * (F.col("y") * 2)).alias("sound_speed_m_s"),
        (F.lit(1.0) / F.col("x")).alias("inverse_frequency_s"),
    )


_TUBE, _ANGLE = "_tube_", "_angle_"
_SPEEDS = ["mean", "sample_std", "sem", "min", "max"]


def _tube_aggregates(frequency: Column, spacing: Column) -> list[Column]:
    """Sound speed statistics and fit sums of spacing on inverse frequency; NULL pairs are not counted."""
    speed = moments(frequency * (spacing * 2))
    sums = fit_sums(F.lit(1.0) / frequency, spacing, _TUBE)
    return [*sums, *[speed[name].alias(f"speed_{name}") for name in _SPEEDS]]


def _unprefixed(sums: DataFrame, prefix: str, *keep: str) -> DataFrame:
    own = {c: c.removeprefix(prefix) for c in sums.columns if c.startswith(prefix)}
    return sums.select("dataset_id", *[F.col(c).alias(n) for c, n in own.items()], *keep)


def resonance_from_sums(sums: DataFrame) -> DataFrame:
    """Datasets with at least one positive pair; with fewer than two their results are NULL."""
    speeds = [f"speed_{name}" for name in _SPEEDS]
    tube = _unprefixed(sums, _TUBE, *speeds).filter("n > 0").withColumns(fit_results())
    fitted = with_p_value(tube)
    enough = F.col("n") >= 2
    return fitted.select(
        "dataset_id",
        "n",
        *[F.when(enough, F.col(name)).alias(name) for name in speeds],
        "slope",
        "intercept",
        "slope_stderr",
        "intercept_stderr",
        (F.col("slope") * 2).alias("c_regression_m_s"),
        (F.col("slope_stderr") * 2).alias("c_regression_stderr_m_s"),
        "r_squared",
        "p_value",
    )


def resonance_summary(points: DataFrame) -> DataFrame:
    """Sound speed statistics and the fit of spacing on inverse frequency, in one pass per dataset."""
    frequency, spacing = F.col("frequency_hz"), F.col("peak_spacing_m")
    return resonance_from_sums(points.groupBy("dataset_id").agg(*_tube_aggregates(frequency, spacing)))


def angular_from_sums(sums: DataFrame) -> DataFrame:
    """Datasets with at least two pairs and two different times."""
    fits = _unprefixed(sums, _ANGLE).withColumns(fit_results()).filter("slope is not null")
    return with_p_value(fits).drop("_mx", "_my", "_sxx", "_syy", "_sxy")


def angular_regression(pairs: DataFrame) -> DataFrame:
    """Fit of angle y on time x."""
    return angular_from_sums(pairs.groupBy("dataset_id").agg(*fit_sums(F.col("x"), F.col("y"), _ANGLE)))


def physics_sums(rows: DataFrame) -> DataFrame:
    """All sums of both evaluations in one pass over the parsed rows, one row per dataset."""
    time, angle = pair_values("time", "angle")
    frequency, spacing = pair_values("frequency", "spacing", positive=True)
    return rows.select(
        "dataset_id",
        time.alias("time"),
        angle.alias("angle"),
        frequency.alias("frequency"),
        spacing.alias("spacing"),
    ).groupBy("dataset_id").agg(
        *fit_sums(F.col("time"), F.col("angle"), _ANGLE),
        *_tube_aggregates(F.col("frequency"), F.col("spacing")),
    )


def latitude_from_rate(regression: DataFrame, metadata: DataFrame) -> DataFrame:
    """Signed latitude from an explicit angular velocity, or from the slope if its unit is radian.

    ``metadata(dataset_id, metadata MAP<STRING,STRING>)`` may lack a dataset.  A rate that is given but is no
    finite number makes the latitude not computable, whatever the slope is.
    """
    text = F.try_element_at("metadata", F.lit("omega_mess_rad_s"))
    given = finite(text.try_cast("double"))
    unreadable = text.isNotNull() & given.isNull()
    unit = F.lower(F.try_element_at("metadata", F.lit("angle_unit")))
    omega = F.coalesce(given, F.when(text.isNull() & unit.isin(RADIAN_UNITS), F.col("slope")))
    share = omega / F.lit(EARTH_RATE_RAD_PER_S)
    inside = F.abs(share) <= 1
    return (
        regression.select("dataset_id", "slope")
        .join(metadata.select("dataset_id", "metadata"), "dataset_id", "left")
        .select(
            "dataset_id",
            (~F.coalesce(inside, F.lit(False))).alias("not_computable"),
            F.when(unreadable, REASON_RATE).when(omega.isNull(), REASON_UNIT).when(~inside, REASON_DOMAIN).alias("reason"),
            omega.alias("omega_mess_rad_s"),
            F.when(inside, share).alias("ratio"),
            F.when(inside, F.degrees(F.asin(share))).alias("latitude_deg"),
            F.lit(False).alias("correction_factor_used"),
        )
    )


def latitude_with_error(rate_deg_h: Column, error_deg_h: Column) -> dict[str, Column]:
    """Unsigned latitude from a rotation rate in degrees per hour, with its uncertainty.

    ``delta_phi_ref`` is the propagated error as an angle in radians, which is what the deviation is
    divided by; ``delta_phi_deg`` is the same error in degrees.
    """
    sine = F.abs(rate_deg_h) / F.lit(EARTH_RATE_DEG_PER_H)
    inside = sine <= 1
    cosine = F.sqrt(F.greatest(1 - sine * sine, F.lit(1e-10)))
    error = F.when(inside, error_deg_h / (F.lit(EARTH_RATE_DEG_PER_H) * cosine))
    latitude = F.when(inside, F.degrees(F.asin(sine)))
    deviation = F.abs(latitude - F.lit(LITERATURE_LATITUDE_DEG))
    return {
        "sin_phi": sine,
        "phi_exp": latitude,
        "delta_phi_ref": error,
        "delta_phi_deg": F.degrees(error),
        "abw_deg": deviation,
        "abw_sigma": F.when(error > 0, ratio(deviation, error)),
        "hinweis_phi": F.when(
            ~inside,
            F.format_string("sin(phi)=%.4f>1 — Messzeit zu kurz oder starke Stoerungen", sine),
        ),
    }
