"""The domain-grain analysis table and samples of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions.skew import lookup_join

OUTCOMES = (
    "urls_specified", "urls_removed", "urls_no_action", "urls_not_in_index",
    "urls_pending", "removal_rate", "from_abuser",
)
REQUEST_CONTEXT = (
    "date", "reporting_org_id", "reporting_org", "copyright_owner_id", "copyright_owner",
)


def prefix_outcomes(df: DataFrame, grain: str) -> DataFrame:
    """Rename the outcome columns to ``<grain>_*`` and leave the others alone."""
    return df.withColumnsRenamed({c: f"{grain}_{c}" for c in OUTCOMES})


def request_context(requests: DataFrame) -> DataFrame:
    return prefix_outcomes(
        requests.select("request_id", *REQUEST_CONTEXT, *OUTCOMES), "request"
    )


def domain_grain(domains: DataFrame) -> DataFrame:
    return prefix_outcomes(domains.select("request_id", "domain", *OUTCOMES), "domain")


def attach_context(domains: DataFrame, context: DataFrame) -> DataFrame:
    """Left join of domain rows to per-request columns."""
    return lookup_join(domains, context, ["request_id"])


def join_domains(domains: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per (request, domain) with the request's context.

    Domains without a request keep null context. One shuffle join on ``request_id``; a
    side measured to be small is broadcast by adaptive execution.
    """
    return attach_context(domain_grain(domains), request_context(requests))


def sample_requests(
    requests: DataFrame, rows: int = settings.SAMPLE_ROWS, seed: int = settings.SEED
) -> DataFrame:
    """Repeatable sample of about ``rows`` requests and never more.

    A request is drawn if the hash of (seed, id), with a null id as empty text, falls below ``rows / total``. Only
    the drawn rows reach the final ``limit``, which trims a lucky surplus.
    """
    total = requests.agg(F.count(F.lit(1)).alias("n")).scalar()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("request_id").cast("string"), F.lit(""))))
    # the first eight hex digits as a fraction of their range
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return (
        requests.withColumns({"_draw": draw, "_digest": digest})
        .where(F.col("_draw") * total < F.lit(rows))
        .orderBy("_digest", "request_id")
        .limit(rows)
        .drop("_draw", "_digest")
    )


def restrict_to(df: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows whose request is in the sample; a semi join, so repeats cannot multiply."""
    return df.join(sampled.select("request_id"), "request_id", "left_semi")


def sample_joined(domains: DataFrame, requests: DataFrame, sampled: DataFrame) -> DataFrame:
    """The joined table of the sampled requests only."""
    return join_domains(restrict_to(domains, sampled), requests)


def check_joined_schema(df: DataFrame) -> DataFrame:
    """Return ``df``; raise ``ValueError`` on bare or missing outcome columns."""
    have = set(df.columns)
    bare = sorted(have.intersection(OUTCOMES))
    if bare:
        raise ValueError(f"outcome columns without a grain prefix: {', '.join(bare)}")
    lost = sorted({f"{g}_{c}" for g in ("domain", "request") for c in OUTCOMES} - have)
    if lost:
        raise ValueError(f"prefixed outcome columns not found: {', '.join(lost)}")
    return df
