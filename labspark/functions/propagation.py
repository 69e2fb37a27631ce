"""Gaussian error propagation and unit scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from labspark.functions.numeric import ratio

# Physical constants used by the derived quantities.
EARTH_RATE_RAD_PER_S = 7.2921159e-5
EARTH_RATE_DEG_PER_H = 15.041
LITERATURE_LATITUDE_DEG = 52.52
GRAVITY_M_PER_S2 = 9.810

SECONDS_PER_MINUTE = 60
SECONDS_PER_HOUR = 3600


def combined_error(*errors: Column) -> Column:
    """Root of the sum of squares of independent error contributions."""
    if len(errors) == 2:
        return F.hypot(*errors)
    total = errors[0] * errors[0]
    for error in errors[1:]:
        total = total + error * error
    return F.sqrt(total)


def frequency_error(period: Column, period_error: Column) -> Column:
    """Error of ``1/T``."""
    return ratio(period_error, period * period)


def angular_frequency_error(period: Column, period_error: Column) -> Column:
    """Error of ``2 pi / T``."""
    return F.lit(2 * math.pi) * frequency_error(period, period_error)


def pendulum_length(period: Column, gravity: float = GRAVITY_M_PER_S2) -> Column:
    return F.lit(gravity / (4 * math.pi**2)) * period * period


def pendulum_length_error(
    period: Column, period_error: Column, gravity: float = GRAVITY_M_PER_S2
) -> Column:
    return F.lit(2 * gravity / (4 * math.pi**2)) * period * period_error


def per_second_to_per_hour(rate: Column) -> Column:
    return rate * F.lit(SECONDS_PER_HOUR)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / F.lit(SECONDS_PER_MINUTE)
