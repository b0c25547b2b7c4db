"""Loading transfer issues from logs and from link statistics."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.operators import transfers as tra
from faultscope.operators.patterns import full_rank
from faultscope.plans.issue_registration import register_issues
from faultscope.sources import files

ACTIVITIES = ("transfer", "deletion")


def log_issues(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Transfer issues of a flat log: grouped, with sites filled in, one row per issue key."""
    return tra.sum_by_key(tra.fill_sites(tra.transfer_error_counts(log), registry))


def load_day(
    spark: SparkSession,
    base: str,
    day: datetime.date,
    registry: DataFrame,
    today: datetime.date | None = None,
    snapshot: str | None = None,
) -> DataFrame:
    """Issues of one day folder of the log, with a snapshot to fall back to."""
    path = files.day_path(base, day, today)
    return files.load_with_snapshot(
        spark,
        lambda: files.read_json(spark, path),
        lambda log: log_issues(log.select("data.*"), registry),
        snapshot,
    )


def inefficiency_issues(
    transfers: DataFrame,
    as_of: datetime.datetime | Column,
    hours: float = 1,
    activity: str = "transfer",
    min_files: int = tra.MIN_FILES,
    max_percent: float = tra.MAX_EFFICIENCY,
) -> DataFrame:
    """Issues of links that failed most of their files of one activity lately, with the main
    reason: files whose ``state`` is the activity, reasons whose ``event_type`` is its failure."""
    links = tra.link_efficiency(transfers, as_of, hours, state=activity)
    reasons = tra.top_reasons(transfers, as_of, hours, event_type=activity)
    return tra.link_issues(tra.inefficient(links, min_files, max_percent), reasons, activity)


def all_inefficiency_issues(
    transfers: DataFrame, as_of: datetime.datetime | Column, hours: float = 1, activities: Sequence[str] = ACTIVITIES, **limits: float
) -> DataFrame:
    """The issues of ``inefficiency_issues`` for every activity; their types tell them apart."""
    found = [inefficiency_issues(transfers, as_of, hours, activity, **limits) for activity in activities]
    return functools.reduce(DataFrame.unionByName, found)


def register_links(
    stored: DataFrame,
    categories: DataFrame,
    transfers: DataFrame,
    as_of: datetime.datetime | Column,
    now: Column,
    hours: float = 1,
    activities: Sequence[str] = ACTIVITIES,
    **limits: float,
) -> tuple[DataFrame, DataFrame]:
    """The issue and the category table after the inefficient links of all activities are registered.

    The issues arrive in the order of their keys, with ids behind those of all categories; see ``register_issues``.
    """
    issues = all_inefficiency_issues(transfers, as_of, hours, activities, **limits)
    last = F.coalesce(categories.agg(F.max("id")).scalar(), F.lit(0))
    placed = full_rank(issues.withColumn("_all", F.lit(0)), "_all", [F.col(c) for c in tra.ISSUE_KEY], "_place")
    arriving = placed.withColumn("id", last + F.col("_place")).drop("_all", "_place")
    return register_issues(stored, categories, arriving, now)
