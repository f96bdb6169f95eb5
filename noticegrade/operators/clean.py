"""Raw request and domain tables to the documented clean schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.functions import scalars as S
from noticegrade.functions.skew import lookup_join

CLEAN_REQUEST_COLUMNS = (
    "request_id", "date", "reporting_org_id", "reporting_org", "copyright_owner_id",
    "copyright_owner", "urls_specified", "urls_removed", "urls_no_action",
    "urls_not_in_index", "urls_pending", "removal_rate", "from_abuser", "lumen_url",
)
CLEAN_DOMAIN_COLUMNS = (
    "request_id", "domain", "urls_specified", "urls_removed", "urls_no_action",
    "urls_not_in_index", "urls_pending", "removal_rate", "from_abuser",
)


def apply_contract(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Keep the mapped source columns under their new names.

    Raises ``ValueError`` naming every source column that is absent.
    """
    have = set(df.columns)
    missing = [source for source in columns if source not in have]
    if missing:
        raise ValueError(f"source columns not found: {', '.join(missing)}")
    return df.select(*(F.col(f"`{source}`").alias(name) for source, name in columns.items()))


def with_outcomes(df: DataFrame) -> DataFrame:
    """Coerce the four counts; add ``urls_specified`` (bigint) and ``removal_rate``."""
    return (
        df.withColumns({c: S.clean_count(F.col(c)) for c in settings.URL_COUNTS})
        .withColumn("urls_specified", S.urls_specified())
        .withColumn("removal_rate", S.removal_rate(F.col("urls_removed"), F.col("urls_specified")))
    )


def canonical_spellings(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Per id its most frequent spelling; ties go to the first in binary order.

    Two partial aggregations and no window: an id that owns a large share of the rows
    is reduced to its distinct spellings before anything meets in one task.
    """
    spellings = df.groupBy(id_col, S.clean_name(F.col(name_col)).alias(name_col)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    named = F.when(F.col(name_col).isNotNull(), F.struct(-F.col("_n"), F.col(name_col)))
    return (
        spellings.groupBy(id_col)
        .agg(F.min(named).alias("_best"))
        .select(id_col, F.col(f"_best.{name_col}").alias("canonical_name"))
    )


def canonicalise(
    df: DataFrame,
    id_col: str,
    name_col: str,
    *,
    spellings_from: DataFrame | None = None,
) -> DataFrame:
    """Give every row of an id the id's canonical spelling.

    Rows with a null id keep their own normalised name.
    """
    source = df if spellings_from is None else spellings_from
    joined = lookup_join(df, canonical_spellings(source, id_col, name_col), [id_col])
    return joined.withColumn(
        name_col, F.coalesce("canonical_name", S.clean_name(F.col(name_col)))
    ).drop("canonical_name")


def typed_requests(raw: DataFrame) -> DataFrame:
    """Contract columns with ids, date, flag and outcomes typed; names still raw."""
    ids = ("request_id", "copyright_owner_id", "reporting_org_id")
    return (
        apply_contract(raw, settings.REQUEST_COLUMNS)
        .withColumns({c: S.parse_id(F.col(c)) for c in ids})
        .withColumns(
            {
                "date": S.parse_day(F.col("date")),
                "from_abuser": S.parse_flag(F.col("from_abuser")),
            }
        )
        .transform(with_outcomes)
    )


def clean_requests(raw: DataFrame, *, spellings_from: DataFrame | None = None) -> DataFrame:
    """Raw request table to the clean request schema.

    ``spellings_from`` is a second handle on the same raw table for the spelling
    counts, used where ``raw`` itself carries row-count observation.
    """
    typed = typed_requests(raw)
    names = typed if spellings_from is None else typed_requests(spellings_from)
    out = typed
    for id_col, name_col in (
        ("copyright_owner_id", "copyright_owner"),
        ("reporting_org_id", "reporting_org"),
    ):
        out = canonicalise(out, id_col, name_col, spellings_from=names)
    return out.select(*CLEAN_REQUEST_COLUMNS)


def clean_domains(raw: DataFrame) -> DataFrame:
    """Raw domain table to the clean domain schema."""
    return (
        apply_contract(raw, settings.DOMAIN_COLUMNS)
        .withColumns(
            {
                "request_id": S.parse_id(F.col("request_id")),
                "domain": S.clean_domain(F.col("domain")),
                "from_abuser": S.parse_flag(F.col("from_abuser")),
            }
        )
        .transform(with_outcomes)
        .select(*CLEAN_DOMAIN_COLUMNS)
    )


def contract_audit(df: DataFrame) -> DataFrame:
    """Counts of doubtful values in a typed table; nothing is dropped for them."""
    negative = F.lit(False)
    for c in settings.URL_COUNTS:
        negative = negative | (F.col(c) < 0)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(negative).alias("negative_count_rows"),
        F.count_if(F.col("removal_rate").isNull()).alias("null_rate_rows"),
    )
