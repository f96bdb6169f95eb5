"""Joins and per-group top-k that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], *, null_safe: bool = False
) -> DataFrame:
    """Left join ``facts`` to ``lookup``, which has one row per key.

    Adaptive execution splits the large partitions of the fact side, whatever their
    number, and broadcasts a lookup it has measured to be small. Null keys match only
    with ``null_safe``; the keys' hash is compared first then, as rows sort faster by a number.
    """
    on = F.lit(True)
    if null_safe and all(facts.schema[k].dataType == lookup.schema[k].dataType for k in keys):
        on = F.xxhash64(*keys) == F.xxhash64(*(f"_k_{k}" for k in keys))
    for k in keys:
        a, b = F.col(k), F.col(f"_k_{k}")
        on = on & (a.eqNullSafe(b) if null_safe else a == b)
    values = [c for c in lookup.columns if c not in keys]
    side = lookup.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *values)
    return facts.join(side, on, "left").drop(*(f"_k_{k}" for k in keys))


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str,
    *,
    spread_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """First ``k`` rows of each group with their rank.

    A group is cut to k rows in each of ``salts`` parts first, so the task that orders
    the rest has at most k times that many rows of it.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    parts = Window.partitionBy(*group, "_salt").orderBy(*order)
    short = salted.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    ranked = short.drop("_r", "_salt").withColumn(rank_col, F.row_number().over(whole))
    return ranked.where(F.col(rank_col) <= k)
