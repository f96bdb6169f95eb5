"""Raw CSV sources and their audit."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade import settings

# ---- fixed values: the raw tables and a column each must have --------------------
EXPECTED_SOURCES = {"requests.csv": "Reporting organization name", "domains.csv": "Domain"}


def read_raw_csv(spark: SparkSession, path, *, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column text. Gzip is told from the extension.

    Quoted fields may span lines, so by default a file is one task, as is any gzip file;
    ``split_csv.read_split_csv`` reads large plain files in many tasks. Set ``multi_line=False``
    for plain files known to have no line breaks in fields, and they are split too.
    """
    return (
        spark.read.option("header", "true")
        .option("multiLine", str(multi_line).lower())
        .option("escape", '"')
        .csv(path)
    )


def read_suffixes(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """Rules of a public-suffix file: the first word of each line that is no comment.

    The rules become part of the plan, so a file of more than ``most`` rules raises.
    """
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([^\s/]\S*)", 1).alias("rule"))
    rules = [r["rule"] for r in lines.where(F.col("rule") != "").distinct().limit(most + 1).collect()]
    if len(rules) > most:
        raise ValueError(f"{path} has more than {most} rules")
    return tuple(sorted(rules))


def land(raw: DataFrame, path: str) -> DataFrame:
    """Write raw text columns to Parquet once, in even parts, and read them back.

    Later stages then never meet the CSV, whose files cannot be split.
    """
    safe = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    safe.hint("rebalance").write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.schema(safe.schema).parquet(path).toDF(*raw.columns)


def _find(spark: SparkSession, folder: str, names) -> dict[str, str]:
    """Path of each named table under the folder, the plain one before its ``.gz``.

    Only paths are listed; no file is opened. A table may be a folder of part files.
    """
    base = folder.rstrip("/")
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    )
    found = {}
    for name in names:
        hit = F.regexp_extract("path", rf"^(.*/{re.escape(name)}(\.gz)?)(/[^/]+)?$", 1)
        kinds = listed.select(hit.alias("file")).where(F.col("file") != "").distinct()
        files = [r["file"] for r in kinds.collect()]
        if files:
            # the highest in the folder, then plain before compressed
            found[name] = min(files, key=lambda f: (f.count("/"), f.endswith(".gz"), f))
    return found


def audit_sources(
    spark: SparkSession, folder: str, expected: Mapping[str, str] = EXPECTED_SOURCES
) -> DataFrame:
    """One row per expected table: the file found (plain, else ``.gz``) and its faults."""
    contracts = {"requests.csv": settings.REQUEST_COLUMNS, "domains.csv": settings.DOMAIN_COLUMNS}
    paths = _find(spark, folder, expected)
    rows = []
    for name, column in expected.items():
        path = paths.get(name)
        header = read_raw_csv(spark, path).columns if path else []
        wanted = [column, *contracts.get(name, {})]
        absent = sorted({c for c in wanted if c not in header})
        rows.append((name, path, path is not None, column in header, absent))
    return spark.createDataFrame(
        rows, "source string, path string, present boolean, recognised boolean, missing array<string>"
    )


def validate_sources(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the expected tables; raises where one is absent or not recognised."""
    audit = audit_sources(spark, folder).orderBy(F.col("source").desc()).collect()
    for row in audit:
        if not row["present"]:
            raise FileNotFoundError(f"{row['source']} (or {row['source']}.gz) not found in {folder}")
        if not row["recognised"]:
            raise ValueError(f"{row['path']} lacks an expected column; missing: {row['missing']}")
    return [row["path"] for row in audit]
