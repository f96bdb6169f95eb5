"""Raw tables to clean, joined and sample tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from noticegrade import settings
from noticegrade.operators.clean import clean_domains, clean_requests
from noticegrade.operators.joined import (
    check_joined_schema,
    join_domains,
    restrict_to,
    sample_requests,
)
from noticegrade.sources.raw import land, read_raw_csv, validate_sources
from noticegrade.sources.split_csv import read_split_csv
from noticegrade.sources.tables import RowCounter, read_table, write_by_month, write_table


@dataclass
class Layout:
    """Where the tables of one run live."""

    base: str

    def path(self, *parts: str) -> str:
        return "/".join([self.base.rstrip("/"), *parts])


def audit_frame(spark: SparkSession, counts: dict[str, tuple[int, int]]) -> DataFrame:
    rows = [(t, raw, clean) for t, (raw, clean) in counts.items()]
    return spark.createDataFrame(rows, "table string, raw_rows long, clean_rows long")


def clean_and_count(
    raw_requests: DataFrame, raw_domains: DataFrame, write
) -> dict[str, tuple[int, int]]:
    """Clean both tables, hand each to ``write(df, name)``, and count rows in that pass."""
    counts = {}
    for name, raw, clean in (
        ("requests", raw_requests, lambda d: clean_requests(d, spellings_from=raw_requests)),
        ("domains", raw_domains, clean_domains),
    ):
        before, after = RowCounter(f"{name}_raw"), RowCounter(f"{name}_clean")
        write(after.watch(clean(before.watch(raw))), name)
        counts[name] = (before.rows, after.rows)
    return counts


def run_ingest(
    spark: SparkSession,
    raw_folder: str,
    out: str,
    *,
    sample_rows: int = settings.SAMPLE_ROWS,
    seed: int = settings.SEED,
    multi_line: bool = True,
) -> DataFrame:
    """The whole job: validate, land, clean, join, sample. Returns the row-count audit.

    Plain files are read by ranges, line breaks in fields included; a gzip file is one task.
    ``multi_line=False`` is for files known to have no line breaks in fields.
    """
    layout = Layout(out)
    paths = validate_sources(spark, raw_folder)

    def read(path: str) -> DataFrame:
        if multi_line and not path.endswith(".gz"):
            return read_split_csv(spark, path)
        return read_raw_csv(spark, path, multi_line=multi_line)

    raw = {
        name: land(read(path), layout.path("landed", name))
        for name, path in zip(("requests", "domains"), paths)
    }
    counts = clean_and_count(
        raw["requests"],
        raw["domains"],
        lambda df, name: write_table(df, layout.path("processed", name)),
    )
    rebuild_joined(spark, out, sample_rows=sample_rows, seed=seed, keep_sample=False)
    return audit_frame(spark, counts)


def rebuild_joined(
    spark: SparkSession,
    out: str,
    *,
    rebuild_full: bool = True,
    keep_sample: bool = True,
    sample_rows: int = settings.SAMPLE_ROWS,
    seed: int = settings.SEED,
) -> DataFrame:
    """Joined table and samples from the clean tables; returns the checked joined sample.

    The request sample is drawn and written once; both other samples follow its ids.
    With ``keep_sample`` a sample already there is used again.
    """
    layout = Layout(out)
    requests = read_table(spark, layout.path("processed", "requests"))
    domains = read_table(spark, layout.path("processed", "domains"))
    joined_path = layout.path("processed", "joined")
    if rebuild_full:
        write_by_month(join_domains(domains, requests), joined_path)
    sample_path = layout.path("sample", "requests")
    if not (keep_sample and _has_table(spark, sample_path)):
        write_table(sample_requests(requests, sample_rows, seed), sample_path)
    sampled = read_table(spark, sample_path)
    few = restrict_to(domains, sampled)
    write_table(few, layout.path("sample", "domains"))
    # every sampled domain row's request is in the sample, so its context is too
    write_table(join_domains(few, sampled), layout.path("sample", "joined"))
    return check_joined_schema(read_table(spark, layout.path("sample", "joined")))


def _has_table(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        read_table(spark, path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


__all__ = ["Layout", "audit_frame", "clean_and_count", "rebuild_joined", "run_ingest"]
