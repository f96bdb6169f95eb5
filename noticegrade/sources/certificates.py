"""Certificate feed messages, from recorded files or as a stream, and the domain store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade.streaming.store import MergedStore

# ---- fixed values: the fields of a feed message that are used ---------------------
MESSAGE_SCHEMA = (
    "message_type string, data struct<leaf_cert: struct<all_domains: array<string>, "
    "issuer: struct<O: string>>, seen: double>"
)


def parse_messages(df: DataFrame, text: str = "value") -> DataFrame:
    """Feed messages held as JSON text; unreadable ones are dropped by ``explode_hosts``."""
    return df.select(F.from_json(text, MESSAGE_SCHEMA).alias("_m")).select("_m.*")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded feed: one JSON message per line."""
    return spark.read.schema(MESSAGE_SCHEMA).json(path)


def stream_messages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same files as a stream: new files in ``path`` are picked up as they arrive."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    )


def store_events(new: DataFrame, path: str, checkpoint: str):
    """Writer that appends a stream of domain events to a Parquet store, by day seen."""
    return (
        new.withColumn("event_date", F.to_date("seen_at"))
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def new_domain_store(path: str, **options) -> MergedStore:
    return MergedStore(path.rstrip("/"), earliest_sighting, **options)


def store_new_domains(events: DataFrame, path: str, checkpoint: str):
    """Writer of the rolling new-domain store: per batch the first sighting of each domain.

    No event is too late for it. A batch run again replaces its own rows, and batches are merged
    into a snapshot as they add up.
    """
    store = new_domain_store(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.add(earliest_sighting(batch), batch_id)

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def earliest_sighting(events: DataFrame) -> DataFrame:
    """One row per domain: its earliest event."""
    return (
        events.groupBy("domain")
        .agg(F.min(F.struct("seen_at", "issuer")).alias("_e"))
        .select("domain", "_e.issuer", "_e.seen_at")
    )


def read_new_domains(spark: SparkSession, path: str) -> DataFrame:
    """First sighting per domain over all batches: the last snapshot and the batches since."""
    return new_domain_store(path).read(spark)
