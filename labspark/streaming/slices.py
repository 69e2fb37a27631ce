"""Angles of time slices while samples arrive.

The state of a slice is its regression sums, which merge; it is dropped once the watermark has passed the slice.
Every micro-batch leaves the slices that it changed, so the last state of a slice is that of its last batch, and a
slice that is still open can be read as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labspark.functions.regression import fit_results, fit_sums
from labspark.operators.pendulum import KEY
from labspark.streaming.arrival import analyse_arrivals, committed_rows

#: Seconds that a timestamp holds; samples beyond them belong to no slice.
_LAST_SECOND = 2.0e11


def _slice_sums(samples: DataFrame, keys: Sequence[str], seconds: float, lateness: str | None) -> DataFrame:
    """``keys, slice, rows`` and the sums of the line y(x) of every slice."""
    micros = round(seconds * 1_000_000)
    # A watermark begins at zero, so times are moved by whole slices until none of them is negative.
    moved = math.ceil(_LAST_SECOND * 1_000_000 / micros)
    at = F.timestamp_micros(F.unix_micros(F.timestamp_seconds("t")) + F.lit(moved * micros))
    timed = samples.filter(F.abs("t") < _LAST_SECOND).select(*keys, at.alias("_at"), "x", "y")
    if lateness is not None:
        timed = timed.withWatermark("_at", lateness)
    sums = timed.groupBy(*keys, F.window("_at", f"{micros} microseconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("rows"), *fit_sums(F.col("x"), F.col("y"))
    )
    number = F.expr(f"unix_micros(_w.start) div {micros} - {moved}").alias("slice")
    return sums.select(*keys, number, *[c for c in sums.columns if c not in (*keys, "_w")])


def slice_arrivals(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = KEY,
    seconds: float = 120.0,
    lateness: str = "10 minutes",
) -> StreamingQuery:
    """Add all samples that have arrived to their slices, then stop; call it again when more have come.

    ``samples`` is a stream with ``keys, t, x, y``.  A sample is late, and dropped, if its slice ended more than
    ``lateness`` before the last sample of the earlier batches; :func:`late_samples` counts them.  Samples
    without a time, or with one that is not finite, belong to no slice.
    """
    sums = _slice_sums(samples, keys, seconds, lateness)
    return analyse_arrivals(sums, out, checkpoint, lambda batch: {"slices": batch}, mode="update")


def _last_states(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    rows = committed_rows(spark, out, "slices")
    names = [*keys, "slice"]
    state = F.struct("batch", *[c for c in rows.columns if c not in (*names, "batch", "attempt")])
    return rows.groupBy(*names).agg(F.max(state).alias("_s")).select(*names, "_s.*").drop("batch")


def read_slices(spark: SparkSession, out: str, keys: Sequence[str] = KEY) -> DataFrame:
    """``keys, slice, n, alpha_deg`` of every slice with a line, as in ``pendulum.slice_angles``."""
    fits = _last_states(spark, out, keys).withColumns(fit_results())
    return fits.filter("slope is not null").select(*keys, "slice", "n", F.degrees(F.atan("slope")).alias("alpha_deg"))


def late_samples(
    samples: DataFrame, out: str, keys: Sequence[str] = KEY, seconds: float = 120.0
) -> DataFrame:
    """``keys, slice, n_late``: samples that came too late for their slice, by comparison with all that arrived.

    ``samples`` is the same folder read as a table.  A slice of which every sample was late is among them.
    """
    arrived = _slice_sums(samples, keys, seconds, None).select(*keys, "slice", F.col("rows").alias("_arrived"))
    states = _last_states(samples.sparkSession, out, keys).select(*keys, "slice", "rows")
    same = [arrived[c].eqNullSafe(states[c]) for c in [*keys, "slice"]]
    late = F.col("_arrived") - F.coalesce("rows", F.lit(0))
    joined = arrived.join(states, same, "left").select(*[arrived[c] for c in [*keys, "slice"]], late.alias("n_late"))
    return joined.filter("n_late > 0")
