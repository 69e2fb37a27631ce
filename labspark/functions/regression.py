"""Straight-line fits as grouped aggregates, with standard errors and the slope's p-value."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.functions.numeric import ratio

# Workers need no installed copy of this module: its vectorised helper travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMS = ["n", "_mx", "_my", "_sxx", "_syy", "_sxy"]


# Nodes and weights on (0, inf) for integrals of exp(-y) f(y): y = exp(x - exp(-x)) in equal steps of x.
_STEPS = np.arange(-5.0, 8.0, 1 / 32)
_NODES = np.exp(_STEPS - np.exp(-_STEPS))
_WEIGHTS = _NODES * (1 + np.exp(-_STEPS)) / 32 * np.exp(-_NODES)


def _half_step(p: np.ndarray) -> np.ndarray:
    """Gamma(p + 1/2) / Gamma(p), by the recurrence up to p + 16 and the asymptotic series from there."""
    factor = np.ones_like(p)
    for k in range(16):
        factor *= (p + k) / (p + k + 0.5)
    q = p + 16
    series = -1 / (8 * q) + 1 / (192 * q**3) - 1 / (640 * q**5) + 17 / (14336 * q**7)
    return factor * np.sqrt(q) * np.exp(series)


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for ``dof`` degrees of freedom; runs on one row per fitted group.

    The tail is an integral over the cosine of the angle with tan = t / sqrt(dof); written as the integral
    of exp(-y) f(y) it has one quadrature for any number of degrees of freedom.
    """
    tv, nu = t.to_numpy(dtype=float), dof.to_numpy(dtype=float)
    out = np.full(len(tv), np.nan)
    known = np.isfinite(tv) & (nu > 0)
    square, n = tv[known, None] ** 2, nu[known, None]
    sine2 = square / (n + square)
    root = np.sqrt(sine2 - n / (n + square) * np.expm1(-2 * _NODES / n))
    tail = np.exp(-n / 2 * np.log1p(square / n))[:, 0] * (_WEIGHTS / root).sum(axis=1)
    out[known] = np.minimum(1.0, 2 / np.sqrt(np.pi) * _half_step(n[:, 0] / 2) * tail / n[:, 0])
    return pd.Series(out)  # NaN becomes NULL in the Arrow transfer


def fit_sums(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Central sums of the complete pairs: partial per task, merged per group, never sum(x^2)-n*mean^2."""
    aggregates = [F.regr_count, F.regr_avgx, F.regr_avgy, F.regr_sxx, F.regr_syy, F.regr_sxy]
    return [agg(y, x).alias(prefix + name) for agg, name in zip(aggregates, _SUMS, strict=True)]


def fit_results(prefix: str = "") -> dict[str, Column]:
    """Fit quantities from the columns of :func:`fit_sums` with the same prefix.

    Fewer than two pairs or a constant x give NULL.  A constant y has r = 0.  Two pairs fit exactly.
    """
    n, mx, my, sxx, syy, sxy = (F.col(prefix + c) for c in _SUMS)
    usable = (n >= 2) & (sxx > 0)
    dof = F.greatest(n - 2, F.lit(0)).cast("double")
    slope = F.when(usable, ratio(sxy, sxx))
    r_raw = F.coalesce(ratio(sxy, F.sqrt(sxx * syy)), F.lit(0.0))
    r = F.when(usable, F.greatest(F.least(r_raw, F.lit(1.0)), F.lit(-1.0)))
    rest = F.when(usable, F.when(dof == 0, 0.0).otherwise(F.greatest(syy - sxy * slope, F.lit(0.0))))
    stderr = F.when(
        usable, F.when(dof == 0, 0.0).otherwise(F.sqrt(ratio(ratio(rest, dof), sxx)))
    )
    return {
        "slope": slope,
        "intercept": my - slope * mx,
        "r_value": r,
        "r_squared": r * r,
        "slope_stderr": stderr,
        "intercept_stderr": stderr * F.sqrt(ratio(sxx, n) + mx * mx),
        "residual_sum_squares": rest,
    }


def with_p_value(fits: DataFrame) -> DataFrame:
    """Add ``p_value`` to rows that carry n, r_value and _syy (one row per group: no wide Python pass)."""
    dof = (F.col("n") - 2).cast("double")
    r = F.col("r_value")
    guard = 1e-20  # keeps |r| = 1 finite
    t = r * F.sqrt(ratio(dof, (1 - r + guard) * (1 + r + guard)))
    exact = F.when(F.col("_syy") > 0, 0.0).otherwise(1.0)
    return fits.withColumn("p_value", student_t_two_sided(F.when(dof > 0, t), dof)).withColumn(
        "p_value", F.when(r.isNull(), None).when(dof == 0, exact).otherwise(F.col("p_value"))
    )


def linear_fit(
    df: DataFrame,
    keys: Sequence[str],
    x: str | Column,
    y: str | Column,
    p_value: bool = False,
    keep: Sequence[Column] = (),
) -> DataFrame:
    """One straight-line fit per group of ``keys``; ``keep`` are further aggregates of the same pass."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    sums = df.groupBy(*keys).agg(*fit_sums(x, y), *keep)
    fits = sums.withColumns(fit_results())
    if p_value:
        fits = with_p_value(fits)
    return fits.drop(*[c for c in _SUMS if c != "n"])
