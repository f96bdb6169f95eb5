"""The radar as streaming jobs.

Work per batch follows the batch, not the history: what is known of a domain is state keyed by
domain, burst baselines open the stored counts of the days they span, and the watchlist and the
store of new domains are a snapshot with a log that is merged into it now and then. Each
micro-batch replaces what it wrote before if it is run again after a failure.

A session that keeps the state of many domains should hold it on disk: see ``state_on_disk``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrade import settings
from noticegrade.operators.radar import (
    BASELINE_HOURS,
    flag_bursts,
    rank_watchlist,
    score_domains,
    sightings,
    window_counts,
)
from noticegrade.streaming.store import DailyStore, MergedStore, days_between

LATENESS = "10 minutes"
COUNTS = "window_start timestamp, signature string, n long"


def state_on_disk(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, beyond the executors' memory."""
    kind = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kind)


def first_sighting_writer(events: DataFrame, store: str, checkpoint: str):
    """Writer that stores a domain with the batch that saw it first, and never again.

    The stream's state has a row for each domain: the batch (by its time) that saw it first,
    with the earliest sighting in that batch. A batch looks up and emits the domains it has, so
    its work doesn't grow with those of all earlier ones.
    """
    arrived = events.withColumn("_arrived", F.current_timestamp())
    known = arrived.groupBy("domain").agg(
        F.min(F.struct("_arrived", "seen_at")).alias("_first"), F.max("_arrived").alias("_last")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col("_first._arrived") == F.col("_last"))
        new.select("domain", F.col("_first.seen_at").alias("seen_at")).write.mode("overwrite").parquet(
            _batch_folder(store, batch_id)
        )

    return known.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(
        "update"
    )


def closed_windows(
    events: DataFrame,
    window_minutes: int = settings.BURST_WINDOW_MINUTES,
    lateness: str = LATENESS,
) -> DataFrame:
    """Counts per window and signature, emitted once the watermark has passed the window.

    Events later than that are not counted here; ``window_writer`` counts them.
    """
    return window_counts(events.withWatermark("seen_at", lateness), window_minutes)


def _batch_folder(base: str, batch_id: int) -> str:
    return f"{base.rstrip('/')}/batch={batch_id}"


def burst_writer(
    windows: DataFrame,
    counts_path: str,
    alerts_path: str,
    checkpoint: str,
    *,
    window_minutes: int = settings.BURST_WINDOW_MINUTES,
    keep_days: int | None = None,
    **options,
):
    """Writer that stores closed windows by day and, per batch, the bursts among them.

    A batch is compared with the stored counts of the 24 hours before it, so it opens the days
    of its own windows and the one before. Counts older than ``keep_days`` (None: all stay)
    before the batch are deleted.
    """
    counts = DailyStore(counts_path.rstrip("/"), "window_start")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # what the state emits is read twice
        counts.add(batch, batch_id)
        first, last = _span(batch, "window_start")
        batch.unpersist()
        if first is None:
            return
        since = first - dt.timedelta(hours=BASELINE_HOURS)
        recent = counts.read(spark, COUNTS, days_between(since, last), batch_id)
        recent = recent.where(F.unix_seconds("window_start") >= int(since.timestamp()))
        flag_bursts(recent, window_minutes, **options).where(
            F.col("is_burst") & (F.col("batch") == batch_id)
        ).drop("batch").write.mode("overwrite").parquet(_batch_folder(alerts_path, batch_id))
        if keep_days is not None:
            counts.forget(spark, (since - dt.timedelta(days=keep_days)).date())

    return windows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(
        "append"
    )


def _utc(seconds: int | None) -> dt.datetime | None:
    return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def _span(df: DataFrame, column: str) -> tuple[dt.datetime | None, dt.datetime | None]:
    """First and last time of a column."""
    found = df.agg(F.min(F.unix_seconds(column)).alias("a"), F.max(F.unix_seconds(column)).alias("b")).first()
    return _utc(found["a"]), _utc(found["b"])


def window_writer(
    events: DataFrame,
    base: str,
    checkpoint: str,
    *,
    window_minutes: int = settings.BURST_WINDOW_MINUTES,
    lateness: dt.timedelta = dt.timedelta(minutes=10),
):
    """Writer that counts every event in its window, however late it comes.

    Below ``base`` a batch leaves ``counts`` (its share of each window, by day), ``late`` (the
    events whose window had closed before the batch, as a side output) and ``corrections`` (the
    new totals of the closed windows that those events belong to, from the stored shares of
    their days). A window has closed when the latest event of earlier batches is ``lateness`` past
    its end; that time goes from batch to batch in ``progress``.
    """
    base = base.rstrip("/")
    counts = DailyStore(f"{base}/counts", "window_start")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.where("seen_at is not null").withColumn("window_start", F.window("seen_at", f"{window_minutes} minutes")["start"])
        latest = None
        if batch_id:
            latest = spark.read.parquet(_batch_folder(f"{base}/progress", batch_id - 1)).first()["latest"]
        closed = F.lit(False)
        if latest is not None:
            end = F.unix_micros("window_start") + window_minutes * 60_000_000
            closed = end <= latest - int(lateness.total_seconds() * 1e6)
        marked = timed.withColumn("late", closed).persist()
        marked.where("late").drop("late").write.mode("overwrite").parquet(_batch_folder(f"{base}/late", batch_id))
        counts.add(window_counts(marked, window_minutes), batch_id)
        late = spark.read.schema(marked.drop("late").schema).parquet(_batch_folder(f"{base}/late", batch_id))
        first, last = _span(late, "window_start")
        if first is not None:
            share = window_counts(late.drop("window_start"), window_minutes).withColumnRenamed("n", "n_late")
            totals = counts.read(spark, COUNTS, days_between(first, last), batch_id)
            totals = totals.groupBy("window_start", "signature").agg(F.sum("n").alias("n"))
            share.join(totals, ["window_start", "signature"]).write.mode("overwrite").parquet(
                _batch_folder(f"{base}/corrections", batch_id)
            )
        own = marked.agg(F.max(F.unix_micros("seen_at")).alias("latest"))
        own.select(F.greatest("latest", F.lit(latest).cast("long")).alias("latest")).write.mode("overwrite").parquet(
            _batch_folder(f"{base}/progress", batch_id)
        )
        marked.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(
        "append"
    )


def read_window_counts(spark: SparkSession, base: str, days=None) -> DataFrame:
    """Events per window and signature over all batches stored so far, late ones included."""
    stored = DailyStore(f"{base.rstrip('/')}/counts", "window_start").read(spark, COUNTS, days)
    return stored.groupBy("window_start", "signature").agg(F.sum("n").alias("n"))


def merge_sightings(partial: DataFrame) -> DataFrame:
    """Partial sightings of many batches to one row per domain."""
    return partial.groupBy("domain").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("sightings").alias("sightings"),
        F.max("risk").alias("risk"),
    )


def watchlist_store(path: str, **options) -> MergedStore:
    return MergedStore(path.rstrip("/"), merge_sightings, **options)


def watchlist_writer(events: DataFrame, scorer: DataFrame, store: str, checkpoint: str):
    """Writer that scores each batch's domains and adds them to the watchlist's store."""
    kept = watchlist_store(store)

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = score_domains(sightings(batch), scorer)
        kept.add(scored.select("domain", "first_seen", "last_seen", "sightings", "risk"), batch_id)

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(
        "append"
    )


def read_watchlist(spark: SparkSession, store: str, k: int = 100) -> DataFrame:
    """The watchlist as of the batches stored so far: the last snapshot and the batches since."""
    return rank_watchlist(watchlist_store(store).read(spark), k)


def drain(writer) -> None:
    """Run a writer over everything available, then stop.

    Run again with the same checkpoint it goes on from there.
    """
    writer.trigger(availableNow=True).start().awaitTermination()
