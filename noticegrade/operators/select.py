"""Selection under a time budget, per decision group.

A decision group is one budget to spend, by default one replay step. Costs and budgets are
minutes and count in ticks: ``ticks_per_minute=2`` allows half minutes. A cost or budget
that is no whole number of ticks raises, it is never rounded. Nothing here holds a whole
group in one task: a budget of B ticks leaves at most B candidates of cost c >= 1 that can
matter, and the rest are cut by ``top_k_per_group``. Free candidates are all taken, one
without a known cost is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions.skew import top_k_per_group

KEY = ("request_id", "domain")
# how far from a whole number of ticks binary fractions of minutes may be
_WHOLE = 1e-9
# a group's largest value in the units that selections add up
_PARTS = 1 << 40


def add_owner_weight(
    df: DataFrame, weights: DataFrame, owner: str = "copyright_owner_id"
) -> DataFrame:
    """Attach each owner's importance, 1.0 where none is listed.

    The list may be long, so its measured size decides between broadcast and shuffle,
    and adaptive execution splits a large owner.
    """
    listed = weights.select(F.col(owner), F.col("weight").cast("double").alias("weight"))
    return df.join(listed, owner, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def expected_value(prob_col: str = "score", weight_col: str = "weight") -> Column:
    """Chance of action times importance."""
    return F.col(prob_col) * F.col(weight_col)


def with_value(df: DataFrame, prob_col: str = "score", weight_col: str = "weight") -> DataFrame:
    return df.withColumn("expected_value", expected_value(prob_col, weight_col))


def _ticks(minutes: float, ticks_per_minute: int) -> int:
    ticks = round(minutes * ticks_per_minute)
    if abs(ticks - minutes * ticks_per_minute) > _WHOLE:
        raise ValueError(f"{minutes} minutes are no whole number of ticks; raise ticks_per_minute")
    return ticks


def _affordable(df: DataFrame, cost: str | float, budget: int, ticks_per_minute: int) -> DataFrame:
    """Candidates that fit the budget on their own, with ``_cost`` in ticks.

    A negative cost, and one that is no whole number of ticks, raises.
    """
    if not isinstance(cost, str):
        return _checked(df, F.lit(_ticks(cost, ticks_per_minute)), budget)
    exact = F.col(cost).cast("double") * ticks_per_minute
    broken = F.raise_error(F.lit("a cost is no whole number of ticks")).cast("bigint")
    ticks = F.when(F.abs(exact - F.round(exact)) > _WHOLE, broken).otherwise(F.round(exact).cast("bigint"))
    return _checked(df, ticks, budget)


def _checked(df: DataFrame, ticks: Column, budget: int) -> DataFrame:
    negative = F.raise_error(F.lit("a candidate has a negative cost")).cast("bigint")
    ticks = F.when(ticks < 0, negative).otherwise(ticks.cast("bigint"))
    return df.withColumn("_cost", ticks).where(F.col("_cost") <= budget)


def _minutes(ticks: Column, ticks_per_minute: int) -> Column:
    return ticks if ticks_per_minute == 1 else ticks / ticks_per_minute


def greedy_select(
    df: DataFrame,
    budget: float = settings.BUDGET_MINUTES,
    cost: str | float = settings.COST_MINUTES,
    *,
    group: Sequence[str] = ("step_start",),
    value: str = "expected_value",
    key: Sequence[str] = KEY,
    ticks_per_minute: int = 1,
) -> DataFrame:
    """Take candidates by value per minute until one no longer fits.

    Order: value per minute, then value, then key. Adds ``cumulative_cost`` in minutes: a
    whole number with one tick a minute, else a double.
    """
    budget = _ticks(budget, ticks_per_minute)
    fits = _affordable(df, cost, budget, ticks_per_minute)
    none = _minutes(F.lit(0).cast("bigint"), ticks_per_minute)
    free = fits.where(F.col("_cost") == 0).withColumn("cumulative_cost", none)
    paid = fits.where(F.col("_cost") > 0).withColumn(
        "_density", F.col(value) / F.col("_cost")
    )
    order = [F.col("_density").desc(), F.col(value).desc(), *key]
    # the first budget + 1 candidates of a group cost at least budget + 1 ticks in total
    front = top_k_per_group(paid, group, order, budget + 1, "_rank", spread_by=key)
    running = Window.partitionBy(*group).orderBy("_rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    taken = (
        front.withColumn("cumulative_cost", F.sum("_cost").over(running))
        .where(F.col("cumulative_cost") <= budget)
        .withColumn("cumulative_cost", _minutes(F.col("cumulative_cost"), ticks_per_minute))
        .drop("_density", "_rank")
    )
    return taken.unionByName(free).drop("_cost")


def _units(values: np.ndarray) -> np.ndarray:
    """Values in parts of the largest one, as whole numbers: sums of a few hundred are exact."""
    return np.floor(values / values.max() * _PARTS + 0.5).astype(np.int64)


def _fill(costs: np.ndarray, units: np.ndarray, budget: int) -> np.ndarray:
    """Mask of the rows in the best subset. The rows are few: see ``optimal_select``.

    Going back over the rows from the last, a row is in only where no subset of the ones before
    it does as well without it, which makes the answer unique.
    """
    best = np.zeros(budget + 1, np.int64)
    used = np.zeros((len(costs), budget + 1), dtype=bool)
    for i, (c, v) in enumerate(zip(costs, units)):
        with_item = best[: budget + 1 - c] + v
        used[i, c:] = with_item > best[c:]
        best[c:] = np.maximum(best[c:], with_item)
    left, mask = budget, np.zeros(len(costs), dtype=bool)
    for i in range(len(costs) - 1, -1, -1):
        if used[i, left]:
            mask[i] = True
            left -= costs[i]
    return mask


def _frontier(costs: np.ndarray, budget: int) -> np.ndarray:
    """Rows that may be in the answer, for rows in their order (value, then key).

    A row is out of it if more rows that stand before it and cost no more than it does are
    there than a subset with it can hold: one of them is free to take its place.
    """
    others = (budget - costs) // costs.min()
    before = np.array([(costs[:i] <= c).sum() for i, c in enumerate(costs)])
    return before <= others


def optimal_select(
    df: DataFrame,
    budget: float = settings.BUDGET_MINUTES,
    cost: str | float = settings.COST_MINUTES,
    *,
    group: Sequence[str] = ("step_start",),
    value: str = "expected_value",
    key: Sequence[str] = KEY,
    ticks_per_minute: int = 1,
) -> DataFrame:
    """Subset of each group with the greatest total value within the budget.

    No best subset needs more than ``budget // c`` candidates of cost c, so only the
    most valuable of each cost are kept, map-side. What is left of a group is at most
    the sum of ``budget // c`` over c, 261 rows for 60 ticks, and is solved exactly in
    rows x budget steps. With one cost for all, the kept rows are already the answer.

    Values count in 2^40ths of the group's largest value, so equal totals are equal in whatever
    order they are added. Ties: with the candidates in the order of value (largest first), then
    key, two best subsets differ in a last candidate; the one without it is taken. So the answer
    is unique for every input. A null, zero or negative value is never taken.
    """
    budget = _ticks(budget, ticks_per_minute)
    fits = _affordable(df, cost, budget, ticks_per_minute).where(F.col(value) > 0)
    free = fits.where(F.col("_cost") == 0).drop("_cost")
    paid = fits.where(F.col("_cost") > 0)
    order = [F.col(value).desc(), *key]
    if not isinstance(cost, str):
        most = max(budget // max(_ticks(cost, ticks_per_minute), 1), 1)
        kept = top_k_per_group(paid, group, order, most, "_rank", spread_by=key)
        return kept.drop("_rank", "_cost").unionByName(free)
    short = top_k_per_group(paid, [*group, "_cost"], order, budget, "_rank", spread_by=key).where(
        F.col("_rank") * F.col("_cost") <= budget
    )
    keep = short.columns

    def solve(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values([value, *key], ascending=[False] + [True] * len(key))
        items = items[_frontier(items["_cost"].to_numpy(), budget)]
        units = _units(items[value].to_numpy(dtype=float))
        return items[_fill(items["_cost"].to_numpy(), units, budget)][keep]

    chosen = short.groupBy(*group).applyInPandas(solve, short.schema)
    return chosen.drop("_rank", "_cost").unionByName(free)


def selection_uplift(
    df: DataFrame,
    budget: float = settings.BUDGET_MINUTES,
    cost: str | float = settings.COST_MINUTES,
    *,
    group: Sequence[str] = ("step_start",),
    value: str = "expected_value",
    key: Sequence[str] = KEY,
    ticks_per_minute: int = 1,
) -> DataFrame:
    """Per group the value captured by the best and by the greedy selection."""
    options = {"group": group, "value": value, "key": key, "ticks_per_minute": ticks_per_minute}

    def captured(selection: DataFrame, name: str) -> DataFrame:
        return selection.groupBy(*group).agg(
            F.sum(value).alias(f"{name}_value"), F.count(F.lit(1)).alias(f"{name}_count")
        )

    best = captured(optimal_select(df, budget, cost, **options), "optimal")
    naive = captured(greedy_select(df, budget, cost, **options), "greedy")
    both = best.join(naive, list(group), "full")
    return both.select(
        *group,
        *(
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("optimal_value", "optimal_count", "greedy_value", "greedy_count")
        ),
    ).withColumn("uplift", F.col("optimal_value") - F.col("greedy_value"))
