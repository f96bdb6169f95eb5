"""Stores that streams add to batch by batch, and that stay cheap to read.

``MergedStore`` holds rows that are merged by key: a snapshot of all batches up to one, and the
log of batches since. When the log has grown to a share of the snapshot, both are merged into
the next snapshot, so each row is rewritten a bounded number of times on average, and a reader
opens one snapshot and the batches since, however long the stream has run.

``DailyStore`` holds rows by day, so a reader opens only the days it asks for.

A batch that is run again replaces its own rows in both. A folder counts once its writer has
marked it complete.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str, key: str) -> dict[str, str]:
    """Value and path of the sub-folders ``key=value``; none if the folder isn't there."""
    path, system = _files(spark, folder)
    if not system.exists(path):
        return {}
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return {n.removeprefix(f"{key}="): f"{folder}/{n}" for n in names if n.startswith(f"{key}=")}


def complete(spark: SparkSession, folder: str) -> bool:
    path, system = _files(spark, f"{folder}/_SUCCESS")
    return system.exists(path)


def size_of(spark: SparkSession, folder: str) -> int:
    path, system = _files(spark, folder)
    return system.getContentSummary(path).getLength()


def remove(spark: SparkSession, folder: str) -> None:
    path, system = _files(spark, folder)
    system.delete(path, True)


@dataclass(frozen=True)
class MergedStore:
    """Batches of rows below ``path``; ``merge`` makes one row a key of any number of them.

    ``merge`` gives the columns it takes, and merging merged rows with others gives what merging
    all would. The log is merged into a snapshot once it has ``least_batches`` and ``share`` of
    the snapshot's bytes. ``keep`` snapshots stay for readers that have begun, and for reading
    the store as it was.
    """

    path: str
    merge: Callable[[DataFrame], DataFrame]
    least_batches: int = 4
    share: float = 0.5
    keep: int = 2

    def _log(self, spark: SparkSession) -> dict[int, str]:
        found = listed(spark, f"{self.path}/log", "batch")
        return {int(k): p for k, p in found.items() if complete(spark, p)}

    def _snapshots(self, spark: SparkSession) -> dict[int, str]:
        found = listed(spark, f"{self.path}/snapshot", "upto")
        return {int(k): p for k, p in found.items() if complete(spark, p)}

    def parts(self, spark: SparkSession, upto: int | None = None, below: int | None = None) -> tuple[str | None, list[str]]:
        """(snapshot, log folders since) that hold all batches up to ``upto``; the snapshot is of a batch before ``below``."""
        fits = lambda k: (upto is None or k <= upto) and (below is None or k < below)
        base = max((k for k in self._snapshots(spark) if fits(k)), default=None)
        log = {k: p for k, p in self._log(spark).items() if (base is None or k > base) and (upto is None or k <= upto)}
        return base if base is None else f"{self.path}/snapshot/upto={base}", [log[k] for k in sorted(log)]

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The merged rows of all batches, or of those up to one whose log is still there."""
        base, log = self.parts(spark, upto)
        return self.merge(spark.read.parquet(*([base] if base else []), *log))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch, in place of what an earlier try has stored; merge the log if it's due."""
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        base, log = self.parts(spark, batch_id, below=batch_id)
        if len(log) < self.least_batches:
            return
        if base and sum(size_of(spark, p) for p in log) < self.share * size_of(spark, base):
            return
        merged = self.merge(spark.read.parquet(*([base] if base else []), *log))
        merged.write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={batch_id}")
        self._prune(spark)

    def _prune(self, spark: SparkSession) -> None:
        snapshots = self._snapshots(spark)
        kept = sorted(snapshots)[-self.keep :]
        if len(snapshots) <= self.keep:
            return
        for k in set(snapshots) - set(kept):
            remove(spark, snapshots[k])
        for k, path in self._log(spark).items():
            if k <= kept[0]:
                remove(spark, path)


@dataclass(frozen=True)
class DailyStore:
    """Rows below ``path`` in folders by the day (UTC) of the time ``column``, then by batch."""

    path: str
    column: str

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's rows in their days. The same batch must have the same days if it's run again."""
        day = F.date_from_unix_date(F.floor(F.unix_seconds(self.column) / 86_400).cast("int"))
        dated = rows.withColumn("day", day).withColumn("batch", F.lit(batch_id).cast("long"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def read(self, spark: SparkSession, schema: str, days: Iterable[dt.date] | None = None, upto: int | None = None) -> DataFrame:
        """Rows with their ``batch``, of the days given (all by default) and of batches up to ``upto``; only those folders are listed."""
        there = listed(spark, self.path, "day")
        wanted = there.values() if days is None else [there[str(d)] for d in days if str(d) in there]
        full = f"{schema}, day date, batch long"
        if not wanted:
            return spark.createDataFrame([], full).drop("day")
        found = spark.read.schema(full).option("basePath", self.path).parquet(*wanted)
        return (found if upto is None else found.filter(F.col("batch") <= upto)).drop("day")

    def forget(self, spark: SparkSession, before: dt.date) -> None:
        """Delete the days before one."""
        for day, path in listed(spark, self.path, "day").items():
            if dt.date.fromisoformat(day) < before:
                remove(spark, path)


def days_between(first: dt.datetime, last: dt.datetime) -> list[dt.date]:
    """The days from that of ``first`` to that of ``last``."""
    n = (last.date() - first.date()).days
    return [first.date() + dt.timedelta(days=k) for k in range(n + 1)]
