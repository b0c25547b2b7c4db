"""Report of a time window over the issue store."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from faultscope.operators import report as rep
from faultscope.session import cut_lineage


def issue_report(
    issues: DataFrame,
    meta: DataFrame,
    ticks: DataFrame,
    date_from: datetime.datetime,
    date_to: datetime.datetime,
    top_n: int = 20,
    metric: str = "loss",
    compute_type: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The top issues of the window and their dense histogram.

    The merged ticks and the short list of top issues are written once, as the metrics and the
    histogram both start from them.
    """
    found = rep.issue_features(
        rep.overlapping_issues(issues, date_from, date_to, compute_type), meta
    )
    observed = rep.observations(found, ticks)
    active = found.join(rep.observation_rollup(observed).select("issue_id"), "issue_id", "left_semi")
    merged_ticks = cut_lineage(rep.merged_observations(active, observed))
    merged = rep.merge_by_features(active, merged_ticks)
    top = cut_lineage(rep.top_issues(merged, top_n, metric))
    return top, rep.dense_histogram(top, merged_ticks)
