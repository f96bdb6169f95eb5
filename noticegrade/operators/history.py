"""Leakage-safe history: what was known about a group before a row's own day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticegrade.functions.skew import lookup_join


def prior_rate_table(
    df: DataFrame, group: str, rate: str, out: str, *, day: str = "date", weight: str | None = None
) -> DataFrame:
    """Per (group, day) the mean of ``rate`` over strictly earlier days.

    Rows are summed to days first, so the window of the largest group holds one row
    per calendar day. Rows without a date neither give nor get history; a null group
    is a group of its own. ``weight`` counts a row that many times.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    counted = F.when(F.col(rate).isNotNull(), w).otherwise(F.lit(0))
    daily = (
        df.where(F.col(day).isNotNull())
        .groupBy(group, day)
        .agg(F.sum(F.col(rate) * w).alias("_sum"), F.sum(counted).alias("_n"))
    )
    earlier = Window.partitionBy(group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    total, n = F.sum("_sum").over(earlier), F.sum("_n").over(earlier)
    return daily.select(group, day, F.when(n > 0, total / n).alias(out))


def add_prior_rates(
    df: DataFrame,
    specs: Sequence[tuple[str, str, str]],
    *,
    day: str = "date",
    weight: str | None = None,
    history_from: DataFrame | None = None,
) -> DataFrame:
    """Add, per (group, rate, out), the group's mean rate over strictly earlier days.

    ``history_from`` holds the same rows as ``df`` with fewer columns. The history
    tables are made from it, not from a frame that already carries other joins, so the
    work grows with the number of histories and not with their nesting.
    """
    source = df if history_from is None else history_from
    for group, rate, out in specs:
        table = prior_rate_table(source, group, rate, out, day=day, weight=weight)
        df = lookup_join(df, table, [group, day], null_safe=True)
    return df


def add_prior_rate(df: DataFrame, group: str, rate: str, out: str, **options) -> DataFrame:
    """Add ``out``: the group's mean ``rate`` over strictly earlier days, else null."""
    return add_prior_rates(df, [(group, rate, out)], **options)


def add_prior_appearances(df: DataFrame, *, day: str = "date") -> DataFrame:
    """Add how often a domain was targeted before this day, and its age in days.

    ``domain_age_days`` counts from the first appearance and is 0 on that day.
    """
    daily = (
        df.where(F.col(day).isNotNull())
        .groupBy("domain", day)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    by_day = Window.partitionBy("domain").orderBy(day)
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    table = daily.select(
        "domain",
        day,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("prior_appearances"),
        F.date_diff(
            F.col(day),
            F.min(day).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        ).alias("domain_age_days"),
    )
    return lookup_join(df, table, ["domain", day], null_safe=True)
