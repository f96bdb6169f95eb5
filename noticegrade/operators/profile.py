"""Exploratory aggregates: volume, noise and naming.

Null rates (nothing specified) are treated as each report defines it: noise counts
leave them out, ``actioned`` shares stated as 100 minus noise take them in, and monthly
noise (total minus actioned) takes them in too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.functions.prefix import exact_quantiles

T = settings.ACTION_THRESHOLD


def is_noise(threshold: float = T) -> Column:
    return F.col("removal_rate") < threshold


def is_zero() -> Column:
    return F.col("removal_rate") == 0


def _percent(cond: Column) -> Column:
    """Share of all rows, in percent; null counts as not meeting the condition."""
    return 100.0 * F.count_if(cond) / F.count(F.lit(1))


def top_names(requests: DataFrame, name_col: str, n: int = 20) -> DataFrame:
    """The ``n`` names with most requests, with their mean removal rate."""
    return (
        requests.where(F.col(name_col).isNotNull())
        .groupBy(name_col)
        .agg(F.count("request_id").alias("requests"), F.avg("removal_rate").alias("mean_rate"))
        .orderBy(F.col("requests").desc(), name_col)
        .limit(n)
    )


def monthly_volume(requests: DataFrame, threshold: float = T) -> DataFrame:
    return (
        requests.groupBy(F.trunc("date", "MM").alias("year_month"))
        .agg(
            F.count("request_id").alias("total"),
            F.count_if(F.col("removal_rate") >= threshold).alias("actioned"),
        )
        .where(F.col("year_month").isNotNull())
        .withColumn("noise", F.col("total") - F.col("actioned"))
    )


def noise_summary(requests: DataFrame, threshold: float = T) -> DataFrame:
    """Headline noise counts and shares in one row."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_zero()).alias("zero_rate"),
        _percent(is_zero()).alias("zero_rate_pct"),
        F.count_if(is_noise(threshold)).alias("below_threshold"),
        _percent(is_noise(threshold)).alias("noise_pct"),
        F.count_if(F.col("from_abuser")).alias("from_abuser"),
        (100.0 * F.avg(F.col("from_abuser").cast("int"))).alias("from_abuser_pct"),
    ).withColumn("actioned_pct", 100.0 - F.col("noise_pct"))


def _noise_ranking(
    df: DataFrame, key: str, total: str, counted: str, least: int, n: int, threshold: float
) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(counted).alias(total), F.count_if(is_noise(threshold)).alias("noise"))
        .where(F.col(total) >= least)
        .withColumn("noise_pct", F.col("noise") / F.col(total))
        .orderBy(F.col("noise_pct").desc(), key)
        .limit(n)
    )


def org_noise(
    requests: DataFrame, threshold: float = T, min_requests: int = 50, n: int = 15
) -> DataFrame:
    """Organisations by share of their requests below the threshold."""
    return _noise_ranking(
        requests, "reporting_org", "total", "request_id", min_requests, n, threshold
    )


def tld_noise(
    domains: DataFrame, threshold: float = T, min_domains: int = 500, n: int = 20
) -> DataFrame:
    """Last domain labels by share of their rows below the threshold."""
    labelled = domains.withColumn("tld", S.last_label(F.coalesce("domain", F.lit(""))))
    return _noise_ranking(labelled, "tld", "domains", "domain", min_domains, n, threshold)


def with_has_token(domains: DataFrame, tokens=settings.SUSPICIOUS_TOKENS) -> DataFrame:
    return domains.withColumn(
        "has_token", S.has_token(F.coalesce("domain", F.lit("")), tokens).cast("int")
    )


def token_summary(domains: DataFrame, tokens=settings.SUSPICIOUS_TOKENS) -> DataFrame:
    """Count, mean and median rate of domains with and without a suspicious token."""
    flagged = with_has_token(domains, tokens)
    means = flagged.groupBy("has_token").agg(
        F.count("removal_rate").alias("count"), F.avg("removal_rate").alias("mean")
    )
    medians = exact_quantiles(flagged, ["has_token"], "removal_rate", {"median": 0.5})
    return means.join(medians, "has_token", "left")


def token_box(domains: DataFrame, tokens=settings.SUSPICIOUS_TOKENS) -> DataFrame:
    """Box-plot figures of the rate by token presence, over all rows."""
    return exact_quantiles(
        with_has_token(domains, tokens),
        ["has_token"],
        "removal_rate",
        {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0},
    )


def rate_histogram(requests: DataFrame, bins: int = 50) -> DataFrame:
    """Equal bins over [0, 1]; the last bin takes in 1.0."""
    return (
        requests.where(F.col("removal_rate").isNotNull())
        .groupBy(
            F.least(F.floor(F.col("removal_rate") * bins), F.lit(bins - 1)).cast("int").alias("bin")
        )
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("bin_start", F.col("bin") / F.lit(float(bins)))
    )


def dataset_summary(requests: DataFrame, domains: DataFrame, threshold: float = T) -> DataFrame:
    """The closing table of key numbers, one row."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"),
        _percent(F.col("removal_rate") >= threshold).alias("actioned_pct"),
        _percent(is_noise(threshold)).alias("noise_pct"),
        _percent(is_zero()).alias("zero_pct"),
        F.count_distinct("reporting_org").alias("orgs"),
        F.count_distinct("copyright_owner").alias("owners"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ).withColumn("domains", domains.agg(F.count(F.lit(1)).alias("n")).scalar())
