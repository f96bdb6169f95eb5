"""The model's input: domains with request context, features and label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions.skew import lookup_join
from noticegrade.functions.storage import settle
from noticegrade.operators.features import (
    add_domain_features,
    add_naming_features,
    add_request_features,
    add_request_history,
    add_request_shape,
    make_label,
)
from noticegrade.operators.history import add_prior_rates
from noticegrade.operators.joined import attach_context, domain_grain, request_context
from noticegrade.operators.select import add_owner_weight


def model_frame_from_joined(joined: DataFrame) -> DataFrame:
    """Features and label on an existing, written joined table."""
    return (
        joined.transform(
            lambda d: add_request_features(
                d, "request_", "request_"
            )
        )
        .transform(
            lambda d: add_domain_features(
                d, input_prefix="domain_", history_from=joined
            )
        )
        .transform(lambda d: make_label(d, target_col="domain_removal_rate"))
    )


#: What the domain's history, the request's shape and the label are made from.
_SOURCES = (
    "request_id", "domain", "date", "domain_removal_rate", "request_urls_specified", "request_urls_not_in_index",
    "request_urls_no_action",
)
#: What the histories of the organisation and the owner are made from.
_HISTORY_SOURCES = ("reporting_org_id", "copyright_owner_id", "request_removal_rate")


def model_frame(domains: DataFrame, requests: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same frame straight from the clean tables: domains meet requests once.

    Organisation and owner history depend only on the request, so they are attached at
    request grain, weighting each request by its number of domain rows. That is what
    the joined table would weight it by. Only then do the domains join, which bring their own history. ``columns`` names
    the wanted ones (None: all); what they don't need is neither moved nor written.
    ``requests`` is read once, ``domains`` twice.
    """
    per_request = domains.groupBy("request_id").agg(F.count(F.lit(1)).alias("_domain_rows"))
    weighted = (
        request_context(requests)
        .join(per_request, "request_id", "left")
        .withColumn("_domain_rows", F.coalesce("_domain_rows", F.lit(0)))
    )
    if columns is not None:
        read = {*columns, *_SOURCES, *_HISTORY_SOURCES, "_domain_rows"}
        weighted = weighted.select(*(c for c in weighted.columns if c in read))
    # both histories and the rows they are attached to read it; ids may repeat, so its rows are numbered
    weighted = settle(weighted.withColumn("_request_row", F.monotonically_increasing_id()), "weighted")
    # a request without domains has no rows in the joined table; weight 0 says the same
    context = add_request_history(weighted, "request_", "request_", weight="_domain_rows").drop("_domain_rows")
    grain = domain_grain(domains)
    if columns is not None:
        grain = grain.select(*(c for c in grain.columns if c in columns or c in _SOURCES))
        kept = {*columns, *_SOURCES, "_request_row"}
        context = context.select(*(c for c in context.columns if c in kept))
    # a domain's history needs no more of the request than its day, so the rest meets the rows last: what is
    # moved by domain, and written before as several steps read it, is short. Equal names are put
    # side by side and by day, so that they pack well here and where the rows are moved; one number for
    # both sorts faster than the names
    dated = attach_context(grain, weighted.select("request_id", "date", "_request_row"))
    near = F.shiftleft(F.xxhash64("domain"), 16) + F.coalesce(F.unix_date("date"), F.lit(0))
    dated = settle(dated.sortWithinPartitions(near), "attached")
    rates = [("domain", "domain_removal_rate", "domain_historical_hit_rate")]
    known = add_prior_rates(dated, rates, history_from=dated.select("domain", "date", "domain_removal_rate")).drop("date")
    attached = lookup_join(known, context, ["request_id", "_request_row"])
    # the request's shape last: its counts are shorter to move than its ratios
    named = add_naming_features(attached)
    frame = add_request_shape(named, "request_", "request_").transform(lambda d: make_label(d, target_col="domain_removal_rate"))
    shape = [c for c in frame.columns if c not in named.columns and c != "action"]
    first = [*grain.columns, *(c for c in context.columns if c not in ("request_id", "_request_row"))]
    order = [*first, *shape, "domain_historical_hit_rate", *(c for c in named.columns if c not in attached.columns), "action"]
    return frame.select(*(c for c in order if columns is None or c in columns))


def feature_matrix(frame: DataFrame, exclude_outcome_ratios: bool = False) -> DataFrame:
    """Keys, date, the ordered feature columns and the label."""
    drop = settings.OUTCOME_FEATURES if exclude_outcome_ratios else ()
    return frame.select(
        "request_id",
        "domain",
        "date",
        *(c for c in settings.FEATURES if c not in drop),
        "action",
    )


def plain_score() -> Column:
    """A fixed, model-free score from naming and organisation history.

    Uses nothing known only after the decision. It makes ranking, selection and replay
    checkable without training a model.
    """
    rate = F.round(F.coalesce("request_org_historical_hit_rate", F.lit(0.5)), 6)
    z = 2 * (rate - 0.5) + 0.8 * F.col("tld_is_risky") + 0.5 * F.col("suspicious_token_count") - 1
    return F.round(1 / (1 + F.exp(-z)), 6)


def candidates(
    scored: DataFrame, weights: DataFrame | None = None, cutoff: str = settings.CUTOFF_DATE
) -> DataFrame:
    """Held-out rows as candidates: step, score, owner weight and cost in minutes."""
    held = scored.where(F.col("date") >= F.lit(cutoff).cast("date"))
    held = held.withColumn("weight", F.lit(1.0)) if weights is None else add_owner_weight(held, weights)
    return held.withColumn("step_start", F.col("date")).withColumn(
        "cost_minutes", 1 + F.pmod(F.col("request_id") + F.length("domain"), F.lit(5))
    )

