"""Streaming forms of the windowed operators and of the log loading.

All run as micro-batches over files. Windowed sums are kept in update mode: every batch writes
the windows it changed to its own folder, replacing that folder when it is retried, and the
reader takes the newest row of each window. So late rows within the watermark change a window,
rows beyond it are left out, and a lost executor or a restarted query repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultscope.functions import values
from faultscope.operators import transfers as tra
from faultscope.plans.transfer_loading import log_issues
from faultscope.sources.files import TRANSFER_LOG


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, source_format: str = "parquet", **options
) -> DataFrame:
    return spark.readStream.format(source_format).schema(schema).options(**options).load(path)


def failure_windows(
    failures: DataFrame, keys: list[str], minutes: int = 15, lateness: str = "15 minutes"
) -> DataFrame:
    """Loss and number of failed jobs per key in tumbling windows."""
    return _failure_sums(failures.withWatermark("ENDTIME", lateness), keys, minutes)


def closed_failure_windows(
    failures: DataFrame, keys: list[str], id_col: str, minutes: int = 15, lateness: str = "15 minutes"
) -> DataFrame:
    """The same for append mode: each window comes once, when the watermark has passed its end, and is final then.

    A job that is reported again within the lateness counts once; rows behind the watermark are left out. The
    state holds the open windows and the ids of one lateness.
    """
    once = failures.withWatermark("ENDTIME", lateness).dropDuplicatesWithinWatermark([id_col])
    return _failure_sums(once, keys, minutes)


def _failure_sums(failures: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    return (
        failures.groupBy(*keys, F.window("ENDTIME", f"{minutes} minutes").alias("window"))
        .agg(F.sum("LOSTWALLTIME").alias("walltime_loss"), F.count("*").alias("nfailed_jobs"))
        .select(*keys, F.col("window.start").alias("tick_time"), "walltime_loss", "nfailed_jobs")
    )


def link_windows(transfers: DataFrame, hours: int = 1, lateness: str = "1 hour", state: str | None = None) -> DataFrame:
    """Files done and in total per link in hourly windows, of one activity if its ``state`` is given."""
    if state is not None:
        transfers = transfers.filter(F.col("state") == state)
    return (
        transfers.withWatermark("ts", lateness)
        .groupBy("src_site", "dst_site", F.window("ts", f"{hours} hours").alias("window"))
        .agg(F.sum("files_done").alias("files_done"), F.sum("files_total").alias("files_total"))
        .select(
            "src_site", "dst_site", F.col("window.start").alias("hour"), "files_done", "files_total"
        )
    )


def reason_windows(transfers: DataFrame, activity: str, hours: int = 1, lateness: str = "1 hour") -> DataFrame:
    """Failures of an activity per link, window and reason; the state is a number per reason that a link has in an open window."""
    failed = transfers.filter((F.col("event_type") == f"{activity}-failed") & F.col("reason").isNotNull())
    return (
        failed.withWatermark("ts", lateness)
        .groupBy("src_site", "dst_site", "reason", F.window("ts", f"{hours} hours").alias("window"))
        .agg(F.count("*").alias("amount"))
        .select("src_site", "dst_site", F.col("window.start").alias("hour"), "reason", "amount")
    )


def window_issues(
    links: DataFrame, reasons: DataFrame, activity: str, min_files: int = tra.MIN_FILES, max_percent: float = tra.MAX_EFFICIENCY
) -> DataFrame:
    """Issues of inefficient links per window, with the most frequent reason there (the first by name on ties).

    ``links`` and ``reasons`` are what the streams of ``link_windows`` and ``reason_windows`` have led to.
    """
    bad = tra.inefficient(links, min_files, max_percent).select("src_site", "dst_site", "hour")
    rank = F.struct(-F.col("amount"), F.col("reason"))
    top = reasons.groupBy("src_site", "dst_site", "hour").agg(F.min_by(F.struct("reason", "amount"), rank).alias("top"))
    return bad.join(top, ["src_site", "dst_site", "hour"]).select(
        "hour", F.col("top.reason").alias("message"), F.col("top.amount").alias("amount"), "dst_site", "src_site",
        F.lit(f"{activity}-failure").alias("type"),
    )


def write_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    translate: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "update",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each batch below ``path``; by default all files present now, then stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        translate(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of each key among the batches written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return newest.select(*keys, "_row.*")


def inefficient_windows(
    windows: DataFrame, min_files: int = tra.MIN_FILES, max_percent: float = tra.MAX_EFFICIENCY
) -> DataFrame:
    """Link windows over the efficiency limits (see ``link_efficiency``)."""
    return tra.inefficient(windows, min_files, max_percent)


def ingest_issues(
    spark: SparkSession,
    folder: str,
    registry: DataFrame,
    path: str,
    checkpoint: str,
    schema: T.StructType = TRANSFER_LOG,
    **options,
) -> StreamingQuery:
    """Issues of the JSON files that arrive in a day folder, one set of rows per batch."""
    log = stream_files(spark, folder, schema, "json", **options)
    return write_updates(
        log.select("data.*"),
        path,
        checkpoint,
        lambda batch: log_issues(batch, registry),
        mode="append",
    )


def registered_issues(
    spark: SparkSession, path: str, time_of_batch: Callable[[Column], Column]
) -> DataFrame:
    """The issue table that the batches lead to: an issue keeps the amount it first came with,
    and the time of the last batch it appeared in."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*tra.ISSUE_KEY).agg(
        F.min_by("amount", "batch").alias("amount"),
        time_of_batch(F.max("batch")).alias("last_modified"),
    )


def failed_jobs(events: DataFrame) -> DataFrame:
    """Failed rows of a stream of prepared jobs."""
    return events.filter(F.col("JOBSTATUS") == values.FAILED)
