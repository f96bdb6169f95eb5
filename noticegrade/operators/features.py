"""Request and domain features, labels and the model's feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.operators.history import add_prior_rates


def add_request_shape(df: DataFrame, input_prefix: str = "", output_prefix: str = "") -> DataFrame:
    """Size, outcome ratios and calendar parts of a request. No shuffle."""
    specified = F.col(f"{input_prefix}urls_specified")
    return df.withColumns(
        {
            # greatest() passes over nulls; an unknown count stays unknown
            f"{output_prefix}urls_log1p": F.when(
                specified.isNotNull(), F.log1p(F.greatest(specified, F.lit(0)).cast("double"))
            ),
            f"{output_prefix}not_in_index_ratio": S.share_or_zero(
                F.col(f"{input_prefix}urls_not_in_index"), specified
            ),
            f"{output_prefix}no_action_ratio": S.share_or_zero(
                F.col(f"{input_prefix}urls_no_action"), specified
            ),
            f"{output_prefix}dow": F.weekday("date"),
            f"{output_prefix}month": F.month("date"),
        }
    )


def add_request_features(
    df: DataFrame,
    input_prefix: str = "",
    output_prefix: str = "",
    *,
    weight: str | None = None,
) -> DataFrame:
    """Request shape plus the organisation's and the owner's earlier hit rate.

    Works at either grain through the prefixes.
    """
    dated = add_request_history(df, input_prefix, output_prefix, weight=weight)
    return add_request_shape(dated, input_prefix, output_prefix)


def add_request_history(
    df: DataFrame, input_prefix: str = "", output_prefix: str = "", *, weight: str | None = None
) -> DataFrame:
    """The organisation's and the owner's earlier hit rate."""
    rate = f"{input_prefix}removal_rate"
    return add_prior_rates(
        df,
        [
            ("reporting_org_id", rate, f"{output_prefix}org_historical_hit_rate"),
            ("copyright_owner_id", rate, f"{output_prefix}owner_historical_hit_rate"),
        ],
        weight=weight,
    )


def add_naming_features(
    df: DataFrame,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    output_prefix: str = "",
    *,
    risky: Sequence[str] = settings.RISKY_SUFFIXES,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
) -> DataFrame:
    """What the domain's own name shows. No shuffle."""
    name = F.lower(F.coalesce("domain", F.lit("")))
    tld, count = f"{output_prefix}tld", f"{output_prefix}suspicious_token_count"
    # two steps, so that the suffix and the count are worked out once
    return df.withColumns({tld: S.public_suffix(name, suffixes), count: S.token_count(name, tokens)}).withColumns(
        {
            f"{output_prefix}domain_has_suspicious_token": (F.col(count) > 0).cast("int"),
            f"{output_prefix}tld_is_risky": F.col(tld).isin(list(risky)).cast("int"),
            f"{output_prefix}domain_length": F.length(name),
            f"{output_prefix}digit_ratio": S.digit_ratio(name),
            f"{output_prefix}hyphen_count": S.hyphen_count(name),
        }
    )


def add_domain_features(
    df: DataFrame,
    tokens: Sequence[str] = settings.SUSPICIOUS_TOKENS,
    input_prefix: str = "",
    output_prefix: str = "",
    *,
    suffixes: Sequence[str] = settings.PUBLIC_SUFFIXES,
    history_from: DataFrame | None = None,
) -> DataFrame:
    """Naming features plus the exact domain's earlier hit rate. Needs ``date``.

    ``history_from``: see ``add_prior_rates``.
    """
    rate, out = f"{input_prefix}removal_rate", f"{output_prefix}domain_historical_hit_rate"
    # history first: the naming columns then travel through no shuffle
    return add_prior_rates(
        df, [("domain", rate, out)], history_from=history_from
    ).transform(lambda d: add_naming_features(d, tokens, output_prefix, suffixes=suffixes))


def make_label(
    df: DataFrame,
    threshold: float = settings.ACTION_THRESHOLD,
    target_col: str = "removal_rate",
    label_col: str = "action",
) -> DataFrame:
    """1 where the rate reaches the threshold, else 0; a null rate is 0."""
    return df.withColumn(
        label_col, (F.coalesce(F.col(target_col), F.lit(0.0)) >= threshold).cast("int")
    )


def numeric_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cast the feature columns to double; unreadable values become null.

    Raises ``ValueError`` naming every feature column that is absent.
    """
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns not found: {', '.join(missing)}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in features})


def temporal_split(
    df: DataFrame, cutoff: str = settings.CUTOFF_DATE, day: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """(rows before the cutoff, rows on or after it).

    A table written by month has ``year_month``; its folders on the other side aren't read.
    """
    edge = F.lit(cutoff).cast("date")
    before, after = F.col(day) < edge, F.col(day) >= edge
    if "year_month" in df.columns:
        before, after = before & (F.col("year_month") <= cutoff[:7]), after & (F.col("year_month") >= cutoff[:7])
    return df.where(before), df.where(after)


def class_balance(df: DataFrame, cutoff: str, label: str = "action") -> DataFrame:
    """Rows, positive share and smallest class per side of the cutoff."""
    side = F.when(F.col("date") < F.lit(cutoff).cast("date"), "train").otherwise("holdout")
    return (
        df.where(F.col("date").isNotNull())
        .groupBy(side.alias("split"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(label).alias("positive_share"),
            F.least(F.sum(label), F.count(F.lit(1)) - F.sum(label)).alias("smallest_class"),
        )
    )
