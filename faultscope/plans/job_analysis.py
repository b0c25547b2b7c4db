"""From failed jobs to stored issues."""

from __future__ import annotations

import datetime

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultscope.operators import issues as iss
from faultscope.operators import jobs as job
from faultscope.session import cut_lineage, stored
from faultscope.sources import files, stores


@dataclass(frozen=True)
class JobSettings:
    features: list[str] = field(default_factory=lambda: list(job.FEATURES))
    diag_fields: list[str] = field(default_factory=lambda: list(job.DIAG_FIELDS))
    code_fields: list[str] = field(default_factory=lambda: list(job.CODE_FIELDS))
    top_n: int = 20
    margin_minutes: int = 20
    min_importance: float = iss.MIN_IMPORTANCE
    max_overlap: float = iss.MAX_OVERLAP
    tick_minutes: int = 15
    id_col: str = "PANDAID"
    # Hex digits of each field's hash in a signature, all of them by default.
    width: int | None = None


def find_issues(prepared: DataFrame, settings: JobSettings = JobSettings()) -> DataFrame:
    """Issues of the top signatures of prepared jobs, all signatures in one plan.

    The jobs are read for the signature counts, for the cells and for the error texts, so pass a
    written table or a checkpoint; scores, pairs and metrics come from the cells. Issue ids number
    the sets in the order of signature and set.
    """
    frequency = job.signature_frequency(prepared)
    windows = cut_lineage(job.top_signatures(frequency, settings.top_n))
    cells = cut_lineage(
        job.slice_cells(prepared, windows, settings.features, settings.margin_minutes)
    )
    scores = iss.feature_scores(cells, settings.features)
    important = cut_lineage(
        iss.important_values(scores, settings.features, settings.min_importance)
    )
    pairs = iss.feature_pair_counts(cells, important, settings.features)
    sets = cut_lineage(iss.feature_sets(important, pairs))
    metrics = iss.set_metrics(cells, sets, settings.features)
    errors = job.window_errors(prepared, windows, settings.diag_fields)
    nothing = F.create_map().cast("map<string,map<string,bigint>>")
    # The window has no partitions, as its rows are few: at most 2 * top_n signatures with less
    # than 100 / min_importance values each.
    issue_id = F.row_number().over(Window.orderBy("slice", "number")).cast("bigint")
    return metrics.join(errors, "slice", "left").select(
        issue_id.alias("issue_id"),
        F.col("slice").alias("signature"),
        F.col("number").alias("set_number"),
        "features",
        "n_failed",
        "n_success",
        "walltime_loss",
        "purity",
        "window_start",
        "window_end",
        F.coalesce("error_strings", nothing).alias("error_strings"),
    )


def reduce_issues(
    prepared: DataFrame, issues: DataFrame, settings: JobSettings = JobSettings()
) -> DataFrame:
    """Drop issues that lie inside a bigger one, then merge similar ones."""
    overlap = iss.failed_overlap(
        prepared, issues, settings.features, settings.id_col, settings.max_overlap
    )
    kept = cut_lineage(iss.drop_overlapping(issues, overlap))
    return iss.merge_groups(kept, iss.similar_groups(kept))


@dataclass(frozen=True)
class JobAnalysis:
    issues: DataFrame
    ticks: DataFrame


def analyse_jobs(
    jobs: DataFrame, settings: JobSettings = JobSettings(), site_col: str = "SITE"
) -> JobAnalysis:
    """The whole way for a job window (see ``job_scan``): prepared jobs, issues, their payload
    class and their failure ticks. The prepared jobs are written once for the passes over them."""
    prepared = stored(
        job.prepare_jobs(
            jobs,
            settings.features,
            settings.diag_fields,
            settings.code_fields,
            [site_col],
            settings.id_col,
            settings.width,
        ),
        "prepared-jobs",
    )
    found = cut_lineage(find_issues(prepared, settings))
    reduced = cut_lineage(reduce_issues(prepared, found, settings))
    payload = iss.payload_class(prepared, reduced, settings.features, site_col)
    issues = reduced.join(payload, "issue_id", "left").fillna(
        {"is_hpc": False, "is_grid": False, "payload_type": 0}
    )
    ticks = iss.failure_ticks(prepared, reduced, settings.features, settings.tick_minutes)
    return JobAnalysis(issues, ticks)


def run_job_cycle(
    jobs: DataFrame,
    path: str,
    start: datetime.datetime,
    end: datetime.datetime,
    settings: JobSettings = JobSettings(),
    now: datetime.datetime | None = None,
    site_col: str = "SITE",
) -> int:
    """One cycle over the jobs of a window, which end after its start and start before its end (see ``job_window``): open a session, analyse, store issues, features and
    ticks, stamp the session's end, and remove the sessions finished before. Returns the session's id.

    The end is stamped before the earlier sessions go, so a reader always finds a finished one;
    a cycle that breaks off leaves an open session, which readers pass over.
    """
    spark = jobs.sparkSession
    sessions = stores.read_sessions(spark, path)
    # One row per session, and each cycle removes the finished ones.
    known = sessions.select("session_id", F.col("analysis_finished").isNotNull().alias("done")).collect()
    session_id = max((r["session_id"] for r in known), default=0) + 1
    stores.write_session(spark, path, session_id, start, end)
    window = files.job_window(jobs, start, end, label=None, has_modification_time=False, unstarted=True)
    analysis = analyse_jobs(window, settings, site_col)
    stores.write_issue_store(analysis.issues, analysis.ticks, path, session_id)
    finished = now or datetime.datetime.now(datetime.timezone.utc)
    stores.write_session(spark, path, session_id, start, end, finished)
    stores.remove_sessions(spark, path, [r["session_id"] for r in known if r["done"]])
    return session_id
