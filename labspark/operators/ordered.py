"""Row order inside a dataset, without ever putting a whole dataset into one task.

Rows carry ``row_idx``: unique and increasing in file order within a dataset, gaps allowed.  A dataset is
cut into blocks of ``block_rows`` consecutive index values, so a block never holds more rows than that,
however large the dataset is.  Windows run per (dataset, block).  What crosses a block border (the
neighbouring row, the number of rows before the block, a dataset total) comes from one summary row
per block: the only thing ordered per dataset, ``block_rows`` times smaller than the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "_block"
BLOCK_ROWS = 1 << 20


def belongs(keys: Sequence[str], row: str = "row_idx") -> Column:
    """Whether a row has its key and its place; rows without belong to no dataset."""
    known = F.col(row).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def with_block(
    df: DataFrame, keys: Sequence[str], row: str = "row_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the block number.  Rows without key or index belong to no dataset and are dropped."""
    # The block is named in the condition, so that a later join adds none and both its sides share one exchange.
    known = belongs(keys, row) & F.col(BLOCK).isNotNull()
    return df.withColumn(BLOCK, F.expr(f"`{row}` div {int(block_rows)}L")).filter(known)


def into_blocks(
    df: DataFrame, keys: Sequence[str], row: str = "row_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Hash-partition the rows by (keys, block): the single row-level shuffle of an ordered chain.

    Rows and summaries that read the same columns share this exchange, so the input is scanned once.
    """
    return with_block(df, keys, row, block_rows).repartition(*keys, BLOCK)


def annotate(
    blocked: DataFrame,
    keys: Sequence[str],
    row: str = "row_idx",
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    position: str | None = None,
    totals: Mapping[str, Column] | None = None,
    unshuffled: DataFrame | None = None,
) -> DataFrame:
    """Add neighbour values, the 0-based position and dataset totals to every row.

    ``previous`` / ``following`` map new column names to the columns taken from the row before / after,
    ``totals`` maps new names to an expression summed over the dataset.  All of it costs one in-block
    window and one join with the block summary on (keys, block), which the rows are partitioned by already.

    The summary is taken from the blocked rows, or from ``unshuffled`` (the same rows from
    :func:`with_block`) where it needs few columns: then it is combined before a small shuffle of its own.
    """
    previous, following, totals = previous or {}, following or {}, totals or {}
    part = [*keys, BLOCK]
    inside = Window.partitionBy(*part).orderBy(row)
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    whole = Window.partitionBy(*keys)

    def packed(names: Mapping[str, str]) -> Column:
        return F.struct(*[F.col(source).alias(name) for name, source in names.items()])

    local: dict[str, Column] = {}
    summary: list[Column] = []
    across: dict[str, Column] = {}
    # single columns at the borders, not structs, so that the summary is a hash aggregate
    if previous:
        local["_before"] = F.lag(packed(previous)).over(inside)
        for name, source in previous.items():
            summary.append(F.max_by(source, row).alias(f"_last_{name}"))
            across[f"_border_{name}"] = F.lag(f"_last_{name}").over(along)
    if following:
        local["_after"] = F.lead(packed(following)).over(inside)
        for name, source in following.items():
            summary.append(F.min_by(source, row).alias(f"_first_{name}"))
            across[f"_border_{name}"] = F.lead(f"_first_{name}").over(along)
    if position:
        local["_local_position"] = F.row_number().over(inside).cast("bigint") - 1
        summary.append(F.count(F.lit(1)).alias("_rows"))
        running = along.rowsBetween(Window.unboundedPreceding, -1)
        across["_offset"] = F.coalesce(F.sum("_rows").over(running), F.lit(0))
    for name, value in totals.items():
        summary.append(F.sum(value).alias(f"_sum_{name}"))
        across[name] = F.sum(f"_sum_{name}").over(whole)

    blocks = (blocked if unshuffled is None else unshuffled).groupBy(*part).agg(*summary).select(
        *part, *[value.alias(name) for name, value in across.items()]
    )
    rows = blocked.withColumns(local) if local else blocked
    joined = rows.join(blocks, part)

    out: dict[str, Column] = {}
    for names, near in ((previous, F.col("_before")), (following, F.col("_after"))):
        for name in names:
            out[name] = F.when(near.isNotNull(), near[name]).otherwise(F.col(f"_border_{name}"))
    if position:
        out[position] = F.col("_local_position") + F.col("_offset")
    kept = [*blocked.columns, *totals]
    return joined.select(
        *[F.col(c) for c in kept if c not in out], *[value.alias(name) for name, value in out.items()]
    )


def attach(blocked: DataFrame, keys: Sequence[str], per_key: DataFrame) -> DataFrame:
    """Join one row per dataset onto blocked rows by way of (keys, block), so a large dataset stays split."""
    part = [*keys, BLOCK]
    spread = blocked.groupBy(*part).agg(F.lit(1).alias("_one")).drop("_one").join(per_key, list(keys))
    return blocked.join(spread, part)


MEDIAN_BINS = 4096


def exact_median(
    blocked: DataFrame, keys: Sequence[str], value: str, name: str, accuracy: int = 10_000
) -> DataFrame:
    """Exact median per dataset, in bounded memory.

    A mergeable quantile sketch brackets the middle of the distribution with five times its guaranteed
    rank error; values below the bracket collapse into one count, values above are not needed.
    The distinct values inside fall into equal-width bins, and only the bin(s) holding the middle ranks
    are ordered.  The sketch and the bins decide how much is sorted, never the result.
    """
    part = [*keys, BLOCK]
    margin = 5.0 / accuracy
    rows = blocked.filter(F.col(value).isNotNull()).select(*part, value)
    bracket = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(
            value, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy
        ).alias("_bounds"),
    )
    low, high, v = F.col("_bounds")[0], F.col("_bounds")[1], F.col(value)
    share = F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0))
    spread = F.least(F.floor(share * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1))
    counted = (
        attach(rows, keys, bracket)
        .filter(v <= high)
        .groupBy(
            *keys,
            "_n",
            F.when(v >= low, spread).otherwise(-1).alias("_bin"),
            F.when(v >= low, v).alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    lower_rank, upper_rank = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        counted.groupBy(*keys, "_n", "_bin")
        .agg(F.sum("_c").alias("_in_bin"))
        .withColumn("_offset", F.coalesce(F.sum("_in_bin").over(before), F.lit(0)))
        .filter(
            (F.col("_offset") <= upper_rank) & (F.col("_offset") + F.col("_in_bin") > lower_rank)
        )
        .select(*keys, "_bin", "_offset")
    )
    upto = (
        Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = F.col("_offset") + F.col("_seen")
    picked = (
        counted.join(bins, [*keys, "_bin"])
        .withColumn("_seen", F.sum("_c").over(upto))
        .groupBy(*keys)
        .agg(
            F.min(F.when(seen > lower_rank, F.col("_v"))).alias("_lower"),
            F.min(F.when(seen > upper_rank, F.col("_v"))).alias("_upper"),
            F.min("_bin").alias("_first_bin"),
        )
    )
    # The bracket holds both middle ranks by the sketch's guarantee; stop loudly should it ever not.
    missed = (F.col("_first_bin") < 0) | F.col("_upper").isNull()
    return picked.select(
        *keys,
        F.when(missed, F.raise_error(F.lit("median bracket missed")).cast("double"))
        .otherwise((F.col("_lower") + F.col("_upper")) / 2)
        .alias(name),
    )
