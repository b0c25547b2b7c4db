"""Transfer issues: grouping, site lookup, link efficiency, reasons, registration, search."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.functions import text
from faultscope.operators.messages import failed_transfers
from faultscope.sources.files import trailing_window

# Type of issues from transfer logs, link limits (files, percent), page size, and
# the columns a search may sort by.
TRANSFER_ERROR = "transfer-error"
MIN_FILES = 200
MAX_EFFICIENCY = 20
PAGE_SIZE = 100
SORT_COLUMNS = ["id", "last_modified", "src_site", "dst_site"]

ISSUE_KEY = ["message", "src_site", "dst_site", "type"]
HOSTS = ["src_hostname", "dst_hostname"]


def transfer_error_counts(log: DataFrame) -> DataFrame:
    """Failed transfers per message, hosts and sites, as issues with their amount.

    Rows that differ only in the error category belong to one issue.
    """
    return (
        failed_transfers(log)
        .groupBy(
            F.col("t__error_message").alias("message"),
            F.col("dst_site_name").alias("dst_site"),
            F.col("src_site_name").alias("src_site"),
            "src_hostname",
            "dst_hostname",
        )
        .agg(F.count("*").alias("amount"))
        .withColumn("type", F.lit(TRANSFER_ERROR))
    )


def fill_sites(issues: DataFrame, registry: DataFrame) -> DataFrame:
    """Where a site is empty, the site the registry has for the host of the endpoint, else ''.

    Result: the issues by message, sites and type, without the hosts.
    """
    for side in ("src", "dst"):
        lookup = registry.select(F.col("hostname").alias("_host"), F.col("site").alias("_site"))
        # Only rows without a site look one up; the others carry a null key and do not shuffle
        # into the host's group.
        missing = F.coalesce(F.col(f"{side}_site"), F.lit("")) == ""
        key = F.when(missing, text.hostname(F.col(f"{side}_hostname")))
        site = F.when(missing, F.coalesce("_site", F.lit(""))).otherwise(F.col(f"{side}_site"))
        issues = (
            issues.withColumn("_key", key)
            .join(lookup, F.col("_key") == F.col("_host"), "left")
            .withColumn(f"{side}_site", site)
            .drop("_key", "_host", "_site")
        )
    return issues


def sum_by_key(issues: DataFrame) -> DataFrame:
    """One issue per message, sites and type with the total amount."""
    return issues.groupBy(*ISSUE_KEY).agg(F.sum("amount").alias("amount"))


# -- links ----------------------------------------------------------------------------------


def link_efficiency(
    transfers: DataFrame,
    as_of: datetime.datetime | Column | None = None,
    hours: float = 1,
    state: str | None = None,
) -> DataFrame:
    """Files done and in total per link, over the hours before ``as_of`` if given."""
    frame = transfers if as_of is None else trailing_window(transfers, "ts", as_of, hours)
    if state is not None:
        frame = frame.filter(F.col("state") == state)
    return frame.groupBy("src_site", "dst_site").agg(
        F.sum("files_done").alias("files_done"), F.sum("files_total").alias("files_total")
    )


def inefficient(
    links: DataFrame, min_files: int = MIN_FILES, max_percent: float = MAX_EFFICIENCY
) -> DataFrame:
    """Links with more than ``min_files`` files of which less than ``max_percent`` % are done."""
    percent = F.lit(100.0) * F.col("files_done") / F.col("files_total")
    return links.filter(F.col("files_total") > min_files).filter(percent < max_percent)


def top_reasons(
    transfers: DataFrame,
    as_of: datetime.datetime | Column | None = None,
    hours: float = 1,
    size: int = 1,
    event_type: str | None = None,
) -> DataFrame:
    """The most frequent failure reasons of each link."""
    frame = transfers if as_of is None else trailing_window(transfers, "ts", as_of, hours)
    if event_type is not None:
        frame = frame.filter(F.col("event_type") == f"{event_type}-failed")
    counts = (
        frame.filter(F.col("reason").isNotNull())
        .groupBy("src_site", "dst_site", "reason")
        .agg(F.count("*").alias("amount"))
    )
    order = Window.partitionBy("src_site", "dst_site").orderBy(F.desc("amount"), "reason")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def link_issues(links: DataFrame, reasons: DataFrame, activity: str = "transfer") -> DataFrame:
    """An issue per inefficient link from its most frequent reason; links without one drop out."""
    first = reasons.filter(F.col("rank") == 1)
    return links.join(first, ["src_site", "dst_site"]).select(
        F.col("reason").alias("message"),
        "amount",
        "dst_site",
        "src_site",
        F.lit(f"{activity}-failure").alias("type"),
    )


# -- registration and search ----------------------------------------------------------------


def upsert_issues(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The issue table after registration: new keys come in with their amount, known ones keep
    theirs and only get a new ``last_modified``."""
    new = sum_by_key(incoming).select(
        *[F.col(c).alias(f"_{c}") for c in ISSUE_KEY], F.col("amount").alias("_amount")
    )
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ISSUE_KEY]
    arrived = F.col("_amount").isNotNull()
    known = stored.withColumn("_known", F.lit(True))
    return known.join(new, on, "full_outer").select(
        *[F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ISSUE_KEY],
        F.when(F.col("_known"), F.col("amount")).otherwise(F.col("_amount")).alias("amount"),
        F.when(arrived, now).otherwise(F.col("last_modified")).alias("last_modified"),
    )


def add_category_amounts(
    categories: DataFrame, issues: DataFrame, now: Column
) -> DataFrame:
    """The category table (``category, amount, last_modified``) with the amounts of newly
    assigned issues added; unknown categories are created."""
    added = issues.groupBy(F.col("category").alias("_category")).agg(F.sum("amount").alias("_added"))
    joined = categories.join(added, F.col("category") == F.col("_category"), "full_outer")
    total = F.coalesce("amount", F.lit(0)) + F.coalesce("_added", F.lit(0))
    return joined.select(
        F.coalesce("category", "_category").alias("category"),
        total.alias("amount"),
        F.when(F.col("_added").isNotNull(), now).otherwise(F.col("last_modified")).alias("last_modified"),
    )


def search_issues(
    issues: DataFrame,
    issue_id: int | None = None,
    message: str | None = None,
    categories: list[int] | str | None = None,
    order_by: str = "id",
    page: int | None = 1,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Issues by id, part of the message (any case) and categories (list or comma-separated).

    ``order_by`` may start with ``-``; ties are in id order. ``page=None`` gives all rows.
    """
    found = issues
    if message is not None:
        found = found.filter(F.contains(F.lower("message"), F.lower(F.lit(message))))
    found = filter_issues(found, issue_id, categories).orderBy(*sort_order(order_by))
    if page is None:
        return found
    return found.offset((page - 1) * page_size).limit(page_size)


def filter_issues(issues: DataFrame, issue_id: int | None, categories: list[int] | str | None) -> DataFrame:
    """Issues by id and categories (list or comma-separated)."""
    if issue_id is not None:
        issues = issues.filter(F.col("id") == issue_id)
    if categories is not None:
        listed = categories.split(",") if isinstance(categories, str) else categories
        issues = issues.filter(F.col("category").isin([int(c) for c in listed]))
    return issues


def sort_order(order_by: str) -> list[Column]:
    """The column, descending after a ``-``, then the id."""
    column = order_by.lstrip("-")
    if column not in SORT_COLUMNS:
        raise ValueError(f"cannot order by {column}")
    return [F.desc(column) if order_by.startswith("-") else F.asc(column), F.asc("id")]
