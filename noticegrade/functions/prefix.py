"""Running sums, ranks and exact quantiles without a one-task window.

Rows are dealt to ranges of (group, order) whose limits come from the data, so the ranges
are about even however the values cluster. Totals of the ranges, a row for each range and
group in it, give each range its starting offset; the window inside a range does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` written once, with ``_range``: its range in the order of (group, order).

    Range numbers never decrease along the order. Rows that are equal in all of it share
    a range.
    """
    ranged = df.repartitionByRange(*(F.col(g) for g in group), *order)
    return settle(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def _with_offsets(
    ranged: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, str],
    totals: Mapping[str, str],
) -> DataFrame:
    """Per measure its sum before each row of the written ``ranged``, and over its group."""

    def before(w, m: str) -> Column:
        return F.coalesce(F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    across = Window.partitionBy(*group).orderBy("_range")
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(*(F.sum(m).alias(m) for m in measures))
        .select(
            *(F.col(g).alias(f"_g_{g}") for g in group),
            F.col("_range").alias("_offset_range"),
            *(before(across, m).alias(f"_offset_{m}") for m in measures),
            *(F.sum(m).over(Window.partitionBy(*group)).alias(f"_total_{m}") for m in totals),
        )
    )
    same = F.col("_range") == F.col("_offset_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    return ranged.join(offsets, same).select(
        *(c for c in ranged.columns if c != "_range"),
        *((F.col(f"_offset_{m}") + before(inside, m)).alias(out) for m, out in measures.items()),
        *(F.col(f"_total_{m}").alias(out) for m, out in totals.items()),
    )


def running_before(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    measures: Mapping[str, str],
    *,
    totals: Mapping[str, str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add, per measure, its sum over the group's rows that come before this one.

    ``df`` has one row per group and value. ``measures`` maps a column to the name of its
    running sum, ``totals`` to the name of its sum over the whole group.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    return _with_offsets(in_ranges(df, group, order), group, order, measures, totals or {})


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: the row's number from 1 in its group. Equal rows are numbered somehow.

    The rows are moved once: each range is written in its order, with the places of its rows.
    """
    by = [*(F.col(g) for g in group), *order]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_place": place})
    ranged = settle(placed, "ranges")
    across = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    offsets = ends.select(
        *(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_offset_range"),
        (F.coalesce(F.sum("_rows").over(across), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_range") == F.col("_offset_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # written, so that its size is known to be small before the rows are moved for it
    found = ranged.join(settle(offsets, "offsets"), same)
    return found.select(*df.columns, (F.col("_place") + F.col("_shift")).alias(out))


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows per group and distinct value, as (group, _v, _n). Nulls and NaN are left out."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def quantiles_of_counts(
    counted: DataFrame,
    group: Sequence[str],
    quantiles: Mapping[str, float],
) -> DataFrame:
    """Interpolated quantiles per group from (group, _v, _n) rows: one row per group."""
    located = running_before(
        counted, group, "_v", {"_n": "_before"}, totals={"_n": "_total"}
    )

    def at(index: Column) -> Column:
        inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    outs = []
    for name, q in quantiles.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        share = F.max(spot - F.floor(spot))
        outs.append((low + (high - low) * share).alias(name))
    return located.groupBy(*group).agg(*outs)


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
) -> DataFrame:
    """Interpolated quantiles of ``value`` per group: one row per group.

    Gives what the exact ``percentile`` aggregate gives. That aggregate holds every
    distinct value of a group in one task; here values are counted first and the
    order statistics are looked up in the running counts.
    """
    return quantiles_of_counts(value_counts(df, group, value), group, quantiles)
