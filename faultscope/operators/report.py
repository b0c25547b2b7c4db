"""Report over stored issues: observations, merging, top issues, histogram."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions import values

METRICS = {"loss": "walltime_loss", "fails": "nfailed_jobs"}


def overlapping_issues(
    issues: DataFrame,
    date_from: datetime.datetime,
    date_to: datetime.datetime,
    compute_type: str | None = None,
) -> DataFrame:
    """Issues observed within the window, optionally of one compute type (``hpc`` or ``grid``)."""
    found = issues.filter(
        (F.col("observation_started") < F.lit(date_to))
        & (F.col("observation_finished") > F.lit(date_from))
    )
    if compute_type and compute_type != "all":
        found = found.filter(F.col("payload_type") == values.PAYLOAD_CODES[compute_type])
    return found


def issue_features(issues: DataFrame, meta: DataFrame) -> DataFrame:
    """Issues with their key/value rows as one ``features`` map; issues without any drop out. Of several values of
    a key the greatest counts."""
    single = meta.groupBy("issue_id", "key").agg(F.max("value").alias("value"))
    features = single.groupBy("issue_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("features")
    )
    return issues.join(features, "issue_id")


def observations(issues: DataFrame, ticks: DataFrame) -> DataFrame:
    """The stored ticks of the given issues."""
    return ticks.join(issues.select("issue_id"), "issue_id", "left_semi").select(
        "issue_id",
        "tick_time",
        F.coalesce("walltime_loss", F.lit(0)).alias("walltime_loss"),
        F.coalesce("nfailed_jobs", F.lit(0)).alias("nfailed_jobs"),
    )


def observation_rollup(ticks: DataFrame) -> DataFrame:
    """Loss, failures, first and last tick per issue; issues without failures drop out."""
    return (
        ticks.groupBy("issue_id")
        .agg(
            F.sum("walltime_loss").alias("walltime_loss"),
            F.sum("nfailed_jobs").alias("nfailed_jobs"),
            F.min("tick_time").alias("observation_started"),
            F.max("tick_time").alias("observation_finished"),
        )
        .filter(F.col("nfailed_jobs") > 0)
    )


def merged_observations(issues: DataFrame, ticks: DataFrame) -> DataFrame:
    """Ticks of issues with equal features, the newest issue's value where several have one.

    ``issues`` has ``features``; the result is keyed by ``features_key`` and tick.
    """
    keyed = issues.select("issue_id", values.canonical_map(F.col("features")).alias("features_key"))
    return (
        ticks.join(keyed, "issue_id")
        .groupBy("features_key", "tick_time")
        .agg(
            F.max_by("walltime_loss", "issue_id").alias("walltime_loss"),
            F.max_by("nfailed_jobs", "issue_id").alias("nfailed_jobs"),
        )
    )


def merge_by_features(issues: DataFrame, merged_ticks: DataFrame) -> DataFrame:
    """One issue per feature map: newest id, messages of the oldest, metrics of the merged ticks."""
    heads = (
        issues.withColumn("features_key", values.canonical_map(F.col("features")))
        .groupBy("features_key")
        .agg(
            F.max("issue_id").alias("issue_id"),
            F.min_by("err_messages", "issue_id").alias("err_messages"),
            F.count("*").alias("n_merged"),
        )
    )
    totals = merged_ticks.groupBy("features_key").agg(
        F.sum("walltime_loss").alias("walltime_loss"),
        F.sum("nfailed_jobs").alias("nfailed_jobs"),
        F.min("tick_time").alias("observation_started"),
        F.max("tick_time").alias("observation_finished"),
    )
    return heads.join(totals, "features_key")


def top_issues(issues: DataFrame, top_n: int = 20, metric: str = "loss") -> DataFrame:
    """The largest issues by ``loss`` or ``fails``, named by their place; none for other metrics."""
    if metric not in METRICS:
        return issues.withColumn("place", F.lit(0)).withColumn("name", F.lit("")).limit(0)
    order = [F.desc(METRICS[metric]), F.col("issue_id")]
    kept = issues.orderBy(*order).limit(top_n)
    # At most top_n rows are left to number.
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return kept.withColumn("place", place).withColumn(
        "name", F.concat(F.lit("N_"), F.col("place").cast("string"))
    )


def dense_histogram(top: DataFrame, merged_ticks: DataFrame) -> DataFrame:
    """Loss and failures of every top issue at every tick any of them has, 0 where it has none.

    ``top`` is the short list of the report, so each tick is filled up from one small array.
    """
    listed = top.agg(
        F.collect_list(F.struct("features_key", "issue_id", "name")).alias("issues")
    )
    shown = merged_ticks.join(top.select("features_key"), "features_key", "left_semi")
    grid = (
        shown.select("tick_time")
        .distinct()
        .select("tick_time", F.inline(listed.scalar()))
    )
    return grid.join(shown, ["features_key", "tick_time"], "left").select(
        "name",
        "issue_id",
        "tick_time",
        F.coalesce("walltime_loss", F.lit(0)).alias("walltime_loss"),
        F.coalesce("nfailed_jobs", F.lit(0)).alias("nfailed_jobs"),
    )
