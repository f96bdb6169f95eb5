"""The tables behind the four screens: triage, early warning, outcomes, replay.

The early-warning table is ``operators.radar.watchlist`` and the replay frames are
``operators.backtest.replay``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions.storage import settle
from noticegrade.operators.backtest import noise_avoided, one_per_key, precision_at_k, rank_all
from noticegrade.operators.explain import with_top_features
from noticegrade.operators.profile import monthly_volume
from noticegrade.operators.select import KEY, optimal_select, with_value

OUTCOME_COLUMNS = ("action", "domain_removal_rate")


def triage_view(
    candidates: DataFrame,
    contributions: Mapping[str, Column] | None = None,
    *,
    budget: int = settings.BUDGET_MINUTES,
    cost: str | int = settings.COST_MINUTES,
    low_confidence: float = settings.ACTION_THRESHOLD,
) -> DataFrame:
    """Every candidate with rank, value, reasons, whether it is above the cut line, and
    whether its score is low enough to be shown faded. Outcomes are not in the table; rows
    that repeat a candidate are reduced by ``one_per_key``."""
    valued = settle(with_value(one_per_key(candidates.drop(*OUTCOME_COLUMNS))), "valued")
    chosen = optimal_select(valued.select(*_selection_columns(cost)), budget, cost).select(
        *(F.col(k).alias(f"_s_{k}") for k in KEY), F.lit(1).alias("_taken")
    )
    chosen = settle(chosen, "chosen")  # a few rows a step: known to be small before the join
    on = F.lit(True)
    for k in KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    shown = (
        rank_all(valued)
        .join(chosen, on, "left")
        .withColumn("selected", F.coalesce("_taken", F.lit(0)))
        .withColumn("low_confidence", (F.col("score") < low_confidence).cast("int"))
        .drop("_taken", *(f"_s_{k}" for k in KEY))
    )
    return shown if contributions is None else with_top_features(shown, contributions)


def _selection_columns(cost: str | int) -> list[str]:
    extra = [cost] if isinstance(cost, str) else []
    return [*KEY, "step_start", "expected_value", *extra]


def outcomes_view(
    candidates: DataFrame,
    requests: DataFrame,
    *,
    ks: Sequence[int] = settings.PRECISION_KS,
    budget: int = settings.BUDGET_MINUTES,
    cost: str | int = settings.COST_MINUTES,
) -> DataFrame:
    """Monthly report as (year_month, metric, value): mean precision at each k, noise
    avoided and minutes saved, and the request trend."""
    month = F.trunc("step_start", "MM")
    precision = (
        precision_at_k(candidates, ks=ks)
        .groupBy(month.alias("year_month"), F.concat(F.lit("precision_at_"), "k").alias("metric"))
        .agg(F.avg("precision").alias("value"))
    )
    valued = with_value(candidates)
    minutes = float(cost) if isinstance(cost, int) else float(settings.COST_MINUTES)
    avoided = (
        noise_avoided(
            candidates, optimal_select(valued, budget, cost), minutes_per_candidate=minutes
        )
        .groupBy(month.alias("year_month"))
        .agg(
            F.sum("noise_avoided").cast("double").alias("noise_avoided"),
            F.sum("minutes_saved").alias("minutes_saved"),
        )
        .unpivot("year_month", ["noise_avoided", "minutes_saved"], "metric", "value")
    )
    trend = monthly_volume(requests)
    trend = trend.select(
        "year_month", *(F.col(c).cast("double").alias(c) for c in ("total", "actioned", "noise"))
    ).unpivot("year_month", ["total", "actioned", "noise"], "metric", "value")
    return precision.unionByName(avoided).unionByName(trend)
