"""Queries over jobs and the issues found in them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import text
from faultscope.operators import importance as imp
from faultscope.operators import issues as iss
from faultscope.operators import jobs as job
from faultscope.plans import job_analysis as plan
from faultscope.session import cut_lineage, scratch_path
from faultscope.sources import files, stores
from workload import fixtures as fix
from workload.fixtures import oracle
from workload.text_queries import mask_ctes

FEATURES = ["COMPUTINGSITE", "DESTINATIONSE", "JEDITASKID"]
DIAG = ["DDMERRORDIAG", "PILOTERRORDIAG"]
CODES = ["PILOTERRORCODE"]
SETTINGS = plan.JobSettings(features=FEATURES, diag_fields=DIAG, code_fields=CODES)
FINE_SETTINGS = plan.JobSettings(
    features=FEATURES, diag_fields=DIAG, code_fields=CODES, min_importance=1
)
TO = datetime.datetime(2024, 1, 20)
FROM = datetime.datetime(2024, 1, 10)


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return fix.jobs(spark, folder).join(fix.tasks(spark, folder), "JEDITASKID")


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return job.prepare_jobs(_jobs(spark, folder), FEATURES, DIAG, CODES, ["SITE"])


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    """An issue table from the jobs: the sites, and each site with each storage, that failed;
    their windows end a day before the last failure."""
    failed = job.select_features(fix.jobs(spark, folder), FEATURES).filter("JOBSTATUS = 'failed'")
    both = F.create_map(
        F.lit("COMPUTINGSITE"), F.col("COMPUTINGSITE"), F.lit("DESTINATIONSE"), F.col("DESTINATIONSE")
    )
    site = F.create_map(F.lit("COMPUTINGSITE"), F.col("COMPUTINGSITE"))
    number = F.expr("CAST(substring(COMPUTINGSITE, 6) AS INT)")
    storage = F.expr("coalesce(try_cast(substring(DESTINATIONSE, 4) AS INT), 9)")
    kinds = F.array(
        F.struct((number + 1).alias("issue_id"), site.alias("features")),
        F.struct(((number + 1) * 100 + storage).alias("issue_id"), both.alias("features")),
    )
    rows = failed.select("ENDTIME", F.inline(kinds))
    keyed = rows.select(
        "ENDTIME", "issue_id", F.to_json("features").alias("key")
    ).groupBy("issue_id", "key").agg(
        F.min("ENDTIME").alias("window_start"),
        (F.max("ENDTIME") - F.expr("INTERVAL 1 DAY")).alias("window_end"),
    )
    return keyed.select(
        F.col("issue_id").cast("bigint").alias("issue_id"),
        F.from_json("key", "map<string,string>").alias("features"),
        "window_start",
        "window_end",
    )


def _lower(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


def _feature_text(column: str = "features"):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ),
        ",",
    )


def _count_text(counts):
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda t: F.concat(t["key"], F.lit("="), t["value"])), "/")


def lost_walltime(spark: SparkSession, folder: str) -> DataFrame:
    frame = job.with_lost_walltime(job.with_outcome(fix.jobs(spark, folder)))
    return _lower(frame.select("PANDAID", "ISSUCCESS", "ISFAILED", "LOSTWALLTIME"))


def feature_select(spark: SparkSession, folder: str) -> DataFrame:
    return _lower(job.select_features(_jobs(spark, folder), [*FEATURES, "SITE"]).select("PANDAID", *FEATURES, "SITE"))


def job_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.job_scan(
        fix.jobs(spark, folder), fix.tasks(spark, folder), FROM, TO, None, has_modification_time=False
    )
    return _lower(rows.select("PANDAID", "JEDITASKID", "JOBSTATUS", "ENDTIME", "SITE"))


def job_scan_managed(spark: SparkSession, folder: str) -> DataFrame:
    """The scan with its own predicates: managed jobs that were modified since the window's start."""
    jobs = fix.jobs(spark, folder).withColumns({
        "PRODSOURCELABEL": F.when(F.col("PANDAID") % 3 != 0, "managed").when(F.col("PANDAID") % 2 == 0, "user"),
        "MODIFICATIONTIME": F.col("ENDTIME") + F.make_dt_interval(days=(F.col("PANDAID") % 5 - 2).cast("int")),
    })
    rows = files.job_scan(jobs, fix.tasks(spark, folder), FROM, TO)
    return _lower(rows.select("PANDAID", "JEDITASKID", "PRODSOURCELABEL", "MODIFICATIONTIME", "SITE"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The job-to-task join shape on the large tables: all lines with their order."""
    lines = fix.table(spark, folder, "lineitem")
    orders = fix.table(spark, folder, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority", "l_returnflag").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")
    )


def trailing_window(spark: SparkSession, folder: str) -> DataFrame:
    jobs = fix.jobs(spark, folder)
    recent = files.trailing_window(jobs, "ENDTIME", jobs.agg(F.max("ENDTIME")).scalar(), 12)
    return _lower(recent.select("PANDAID", "ENDTIME"))


def error_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fix.jobs(spark, folder).select(
        F.col("PANDAID").alias("pandaid"), text.short_hash(F.col("PILOTERRORCODE")).alias("code_hash")
    )


def error_signature(spark: SparkSession, folder: str) -> DataFrame:
    return _lower(_prepared(spark, folder).select("PANDAID", *DIAG, *CODES, "combinederrors"))


def signature_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return job.signature_frequency(_prepared(spark, folder))


def top_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return job.top_signatures(job.signature_frequency(_prepared(spark, folder)), 2)


def _windows(prepared: DataFrame) -> DataFrame:
    return job.top_signatures(job.signature_frequency(prepared))


def signature_slice(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    rows = job.signature_slice(prepared, _windows(prepared))
    return rows.groupBy("slice", "COMPUTINGSITE").agg(
        F.count("*").alias("n"), F.sum("PANDAID").alias("ids"), F.sum("ISFAILED").alias("n_failed")
    ).withColumnRenamed("COMPUTINGSITE", "computingsite")


def signature_slice_rows(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    return _lower(job.signature_slice(prepared, _windows(prepared)).select("slice", "PANDAID"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    prepared = cut_lineage(_prepared(spark, folder))
    return cut_lineage(job.slice_cells(prepared, _windows(prepared), FEATURES))


def slice_cells(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    cells = job.slice_cells(prepared, _windows(prepared), FEATURES)
    return _lower(
        cells.groupBy("slice", *FEATURES).agg(
            F.sum("n_failed").alias("n_failed"),
            F.sum("n_success").alias("n_success"),
            F.sum("walltime_loss").alias("walltime_loss"),
            F.min("first_end").alias("first_end"),
            F.max("last_end").alias("last_end"),
        )
    )


def feature_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = iss.feature_scores(_cells(spark, folder), FEATURES)
    rounded = {c: F.round(c, 5) for c in ("gain", "lift", "importance")}
    return scores.withColumns(rounded)


def important_values(spark: SparkSession, folder: str) -> DataFrame:
    important = iss.important_values(iss.feature_scores(_cells(spark, folder), FEATURES), FEATURES)
    return important.withColumn("importance", F.round("importance", 5))


def feature_pairs(spark: SparkSession, folder: str) -> DataFrame:
    cells = _cells(spark, folder)
    important = iss.important_values(iss.feature_scores(cells, FEATURES), FEATURES)
    return iss.feature_pair_counts(cells, important, FEATURES)


def feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    cells = _cells(spark, folder)
    important = iss.important_values(iss.feature_scores(cells, FEATURES), FEATURES)
    sets = iss.feature_sets(important, iss.feature_pair_counts(cells, important, FEATURES))
    return sets.select("slice", "number", _feature_text().alias("features"))


def error_strings(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    errors = job.window_errors(prepared, _windows(prepared), DIAG)
    return errors.select("slice", F.explode("error_strings").alias("field", "texts")).select(
        "slice", "field", F.explode("texts").alias("text", "n")
    )


def find_issues(spark: SparkSession, folder: str) -> DataFrame:
    found = plan.find_issues(cut_lineage(_prepared(spark, folder)), SETTINGS)
    return found.select(
        "signature", "set_number", _feature_text().alias("features"), "n_failed", "n_success",
        "walltime_loss", F.round("purity", 6).alias("purity"), "window_start", "window_end",
    )


def find_issues_fine(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a lower importance limit: more values, and pairs of them."""
    found = plan.find_issues(cut_lineage(_prepared(spark, folder)), FINE_SETTINGS)
    return found.select(
        "issue_id", "signature", _feature_text().alias("features"), "n_failed", "n_success", "walltime_loss"
    )


def issue_list(spark: SparkSession, folder: str) -> DataFrame:
    return _issues(spark, folder).select("issue_id", _feature_text().alias("features"), "window_start", "window_end")


def issue_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = iss.issue_jobs(_prepared(spark, folder), _issues(spark, folder), FEATURES)
    return _lower(found.select("issue_id", "PANDAID"))


def issue_antirows(spark: SparkSession, folder: str) -> DataFrame:
    issues = _issues(spark, folder)
    one = issues.filter(F.col("issue_id") == issues.agg(F.max("issue_id")).scalar())
    return _lower(iss.issue_other_jobs(_prepared(spark, folder), one, FEATURES).select("issue_id", "PANDAID"))


def issue_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = iss.issue_metrics(_prepared(spark, folder), _issues(spark, folder), FEATURES)
    return metrics.withColumn("purity", F.round("purity", 6))


def payload_class(spark: SparkSession, folder: str) -> DataFrame:
    return iss.payload_class(_prepared(spark, folder), _issues(spark, folder), FEATURES)


def issue_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return iss.failed_overlap(_prepared(spark, folder), _issues(spark, folder), FEATURES)


def shared_failed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    prepared, issues = _prepared(spark, folder), _issues(spark, folder)
    return _lower(iss.shared_failed_jobs(prepared, issues, 4, 403, FEATURES))


def issue_reduce(spark: SparkSession, folder: str) -> DataFrame:
    issues = _issues(spark, folder)
    overlap = iss.failed_overlap(_prepared(spark, folder), issues, FEATURES)
    return iss.drop_overlapping(issues, overlap).select("issue_id", _feature_text().alias("features"))


def similar_issues(spark: SparkSession, folder: str) -> DataFrame:
    return iss.similar_groups(_issues(spark, folder))


def merge_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues with their metrics and two error texts each, merged along their similarity."""
    issues = _issues(spark, folder)
    metrics = iss.issue_metrics(_prepared(spark, folder), issues, FEATURES).drop("window_start", "window_end")
    texts = F.map_from_arrays(
        F.array(F.lit("PILOTERRORDIAG"), F.lit("DDMERRORDIAG")),
        F.array(
            F.create_map(F.concat(F.lit("code "), F.col("issue_id") % 3), F.col("n_failed")),
            F.create_map(F.lit("stage-out failed"), F.col("n_success")),
        ),
    )
    full = issues.join(metrics, "issue_id").withColumn("error_strings", texts)
    merged = iss.merge_groups(full, iss.similar_groups(full))
    errors = F.array_sort(
        F.transform(
            F.map_entries("error_strings"),
            lambda e: F.concat(e["key"], F.lit(":"), _count_text(e["value"])),
        )
    )
    return merged.select(
        "issue_id", _feature_text().alias("features"), "n_failed", "n_success", "walltime_loss",
        F.round("purity", 6).alias("purity"), "window_start", "window_end", "n_merged",
        F.array_join(errors, ",").alias("errors"),
    )


def unique_issues(spark: SparkSession, folder: str) -> DataFrame:
    issues = _issues(spark, folder)
    copies = issues.withColumn("issue_id", F.col("issue_id") + 10000)
    return iss.unique_issues(issues.unionByName(copies)).select("issue_id", _feature_text().alias("features"))


def merged_error_counts(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    errors = job.window_errors(prepared, _windows(prepared), DIAG)
    return iss.merge_error_strings(errors.withColumn("all_slices", F.lit("all")), ["all_slices"])


def failure_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return iss.failure_ticks(_prepared(spark, folder), _issues(spark, folder), FEATURES)


def _analysis(spark: SparkSession, folder: str, settings: plan.JobSettings) -> DataFrame:
    analysis = plan.analyse_jobs(_jobs(spark, folder), settings)
    ticks = analysis.ticks.groupBy("issue_id").agg(
        F.count("*").alias("n_ticks"), F.sum("nfailed_jobs").alias("tick_failures")
    )
    return analysis.issues.join(ticks, "issue_id", "left").select(
        "issue_id", _feature_text().alias("features"), "n_failed", "n_success", "walltime_loss",
        F.round("purity", 6).alias("purity"), "window_start", "window_end", "n_merged",
        "payload_type", "n_ticks", "tick_failures",
    )


def job_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder, SETTINGS)


def job_analysis_fine(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder, FINE_SETTINGS)


def job_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Two cycles, over the first half of the month and over all of it; what the store then holds."""
    path = scratch_path(spark, "job-cycle")
    jobs = _jobs(spark, folder)
    start, middle, end = (datetime.datetime(2023, 12, 31), datetime.datetime(2024, 1, 16), datetime.datetime(2024, 2, 2))
    plan.run_job_cycle(jobs, path, start, middle, SETTINGS)
    plan.run_job_cycle(jobs, path, start, end, SETTINGS)
    tables = stores.read_issue_store(spark, path)
    sessions = stores.read_sessions(spark, path)
    ticks = tables["issue_ticks"].groupBy("issue_id").agg(
        F.count("*").alias("n_ticks"), F.sum("nfailed_jobs").alias("tick_failures")
    )
    features = tables["issue_meta"].groupBy("issue_id").agg(F.count("*").alias("n_features"))
    newest = stores.latest_session(tables["issues"], sessions)
    return newest.join(ticks, "issue_id", "left").join(features, "issue_id").select(
        F.col("session_id").cast("bigint").alias("session_id"), "issue_id", "observation_started", "observation_finished",
        "nfailed_jobs", "nsuccess_jobs", "payload_type", "n_features", "n_ticks", "tick_failures",
        sessions.agg(F.count("*")).scalar().alias("n_sessions"),
    )


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted stumps over the slices of the three signatures with the most failures, trained together."""
    prepared = _prepared(spark, folder)
    worst = job.signature_frequency(prepared).orderBy(F.desc("n_failed"), "combinederrors").limit(3)
    return imp.boost_cells(job.slice_cells(prepared, cut_lineage(worst), FEATURES), FEATURES)


QUERIES = {
    f.__name__: f
    for f in (
        lost_walltime, feature_select, job_scan, job_scan_managed, order_lines, trailing_window, error_hash,
        error_signature, signature_frequency, top_signatures, signature_slice, signature_slice_rows,
        slice_cells, feature_scores, important_values, feature_pairs, feature_sets, error_strings,
        find_issues, find_issues_fine, issue_list, issue_rows, issue_antirows, issue_metrics, payload_class,
        issue_overlap, shared_failed_jobs, issue_reduce, similar_issues, merge_issues, unique_issues,
        merged_error_counts, failure_ticks, job_analysis, job_analysis_fine, job_cycle, feature_importance,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_LOST = """CASE WHEN jobstatus = 'failed' AND starttime IS NOT NULL
    THEN (epoch_us(endtime) - epoch_us(starttime)) / 1e6 * CASE WHEN actualcorecount > 0 THEN actualcorecount ELSE 1 END
    ELSE 0.0 END"""

PREPARED = (
    mask_ctes("ddmerrordiag").strip()
    + ","
    + mask_ctes("piloterrordiag")
    + f""",
prepared AS (
  SELECT j.pandaid, jobstatus, starttime, endtime,
    CASE WHEN jobstatus = 'failed' THEN 0 ELSE 1 END AS issuccess,
    CASE WHEN jobstatus = 'failed' THEN 1 ELSE 0 END AS isfailed,
    CAST({_LOST} AS DOUBLE) AS lostwalltime,
    coalesce(computingsite, 'Not specified') AS computingsite,
    coalesce(destinationse, 'Not specified') AS destinationse,
    coalesce(CAST(j.jeditaskid AS VARCHAR), 'Not specified') AS jeditaskid,
    coalesce(t.site, 'Not specified') AS site,
    coalesce(d.masked, 'Not specified') AS ddmerrordiag,
    coalesce(p.masked, 'Not specified') AS piloterrordiag,
    coalesce(CAST(piloterrorcode AS VARCHAR), 'Not specified') AS piloterrorcode
  FROM jobs j JOIN tasks t ON t.jeditaskid = j.jeditaskid
  LEFT JOIN ddmerrordiag_masked d ON d.pandaid = j.pandaid
  LEFT JOIN piloterrordiag_masked p ON p.pandaid = j.pandaid),
signed AS (
  SELECT *, '|' || sha1(ddmerrordiag) || '|' || sha1(piloterrordiag) || '|' || sha1(piloterrorcode) AS combinederrors
  FROM prepared)"""
)
FREQUENCY = (
    PREPARED
    + """,
spans AS (
  SELECT combinederrors, CAST(sum(issuccess) AS BIGINT) AS n_success, CAST(sum(isfailed) AS BIGINT) AS n_failed,
    sum(lostwalltime) AS walltime_loss, min(endtime) AS a, max(endtime) AS b FROM signed GROUP BY combinederrors),
frequency AS (
  SELECT combinederrors, n_success, n_failed, walltime_loss,
    CASE WHEN a = b THEN a - INTERVAL 10 MINUTE ELSE a END AS window_start,
    CASE WHEN a = b THEN b + INTERVAL 10 MINUTE ELSE b END AS window_end FROM spans)"""
)


def _top(n: int) -> str:
    return f""",
by_loss AS (SELECT * FROM frequency ORDER BY walltime_loss DESC, combinederrors LIMIT {n}),
by_failures AS (SELECT * FROM frequency ORDER BY n_failed DESC, combinederrors LIMIT {n}),
windows AS (SELECT * FROM by_loss UNION SELECT * FROM by_failures)"""


SLICE = (
    FREQUENCY
    + _top(20)
    + """,
slices AS (
  SELECT w.combinederrors AS slice, s.* FROM signed s JOIN windows w
  ON (s.combinederrors = w.combinederrors AND s.endtime BETWEEN w.window_start AND w.window_end)
  OR (s.jobstatus = 'finished' AND s.endtime BETWEEN w.window_start - INTERVAL 20 MINUTE AND w.window_end + INTERVAL 20 MINUTE))"""
)
SCORES = (
    SLICE
    + """,
valued AS (
  SELECT slice, pandaid, 1 AS place, 'COMPUTINGSITE' AS feature, computingsite AS value, isfailed, issuccess, lostwalltime FROM slices
  UNION ALL SELECT slice, pandaid, 2, 'DESTINATIONSE', destinationse, isfailed, issuccess, lostwalltime FROM slices
  UNION ALL SELECT slice, pandaid, 3, 'JEDITASKID', jeditaskid, isfailed, issuccess, lostwalltime FROM slices),
counted AS (
  SELECT slice, place, feature, value, CAST(sum(isfailed) AS BIGINT) AS f, CAST(sum(issuccess) AS BIGINT) AS s,
    sum(lostwalltime) AS walltime_loss FROM valued GROUP BY ALL),
totals AS (SELECT slice, CAST(sum(isfailed) AS BIGINT) AS af, CAST(sum(issuccess) AS BIGINT) AS asu FROM slices GROUP BY slice),
gains AS (
  SELECT c.*, af, asu, greatest(0.0, 2.0 * af * asu / (af + asu) - 2.0 * f * s / (f + s)
    - CASE WHEN af + asu > f + s THEN 2.0 * (af - f) * (asu - s) / (af + asu - f - s) ELSE 0 END) AS gain
  FROM counted c JOIN totals t ON t.slice = c.slice),
scores AS (
  SELECT *, sum(gain) OVER (PARTITION BY slice) AS all_gain,
    CASE WHEN sum(gain) OVER (PARTITION BY slice) > 0 THEN 100.0 * gain / sum(gain) OVER (PARTITION BY slice) ELSE 0 END AS importance,
    CASE WHEN af > 0 THEN (f / (f + s)) / (af / (af + asu)) END AS lift FROM gains),
important AS (
  SELECT slice, feature, value, importance,
    CAST(row_number() OVER (PARTITION BY slice ORDER BY place, value) - 1 AS INTEGER) AS number
  FROM scores WHERE importance > 5)"""
)
PAIRS = (
    SCORES
    + """,
hits AS (
  SELECT v.slice, v.pandaid, v.isfailed, i.number FROM valued v
  JOIN important i ON i.slice = v.slice AND i.feature = v.feature AND i.value = v.value),
pairs AS (
  SELECT a.slice, a.number AS first, b.number AS second, CAST(sum(a.isfailed) AS BIGINT) AS n_failed
  FROM hits a JOIN hits b ON a.slice = b.slice AND a.pandaid = b.pandaid AND a.number <= b.number GROUP BY ALL)"""
)
SETS = (
    PAIRS
    + """,
shared AS (SELECT slice, list([first, second]) AS s FROM pairs WHERE n_failed > 0 GROUP BY slice),
sizes AS (SELECT i.slice, count(*) AS n, any_value(s) AS s FROM important i JOIN shared h ON h.slice = i.slice GROUP BY i.slice),
walk AS (
  SELECT slice, 0 AS i, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[][]) AS sets, n, s FROM sizes
  UNION ALL
  SELECT slice, i + 1,
    CASE WHEN list_contains(taken, i) THEN taken ELSE list_concat(taken, partners) END,
    CASE WHEN list_contains(taken, i) THEN sets
      WHEN len(partners) > 0 THEN list_concat(sets, list_transform(partners, lambda j: [CAST(i AS BIGINT), j]))
      WHEN list_contains(s, [i, i]) THEN list_concat(sets, [[CAST(i AS BIGINT)]])
      ELSE sets END, n, s
  FROM (SELECT *, list_filter(generate_series(i + 1, n - 1), lambda j: NOT list_contains(taken, j) AND list_contains(s, [i, CAST(j AS INTEGER)])) AS partners
    FROM walk WHERE i < n)),
ended AS (SELECT slice, sets FROM walk WHERE i = n),
numbered AS (SELECT slice, unnest(sets) AS members, generate_subscripts(sets, 1) - 1 AS number FROM ended),
members AS (SELECT slice, CAST(number AS INTEGER) AS number, unnest(members) AS member, len(members) AS size FROM numbered),
sets AS (
  SELECT m.slice, m.number, any_value(size) AS size, string_agg(feature || '=' || value, ',' ORDER BY feature) AS features
  FROM members m JOIN important i ON i.slice = m.slice AND i.number = m.member GROUP BY m.slice, m.number)"""
)
ISSUES = (
    SETS
    + """,
held AS (
  SELECT m.slice, m.number, h.pandaid FROM members m JOIN hits h ON h.slice = m.slice AND h.number = m.member
  GROUP BY m.slice, m.number, h.pandaid HAVING count(*) = any_value(m.size)),
measured AS (
  SELECT h.slice, h.number, CAST(sum(isfailed) AS BIGINT) AS n_failed, CAST(sum(issuccess) AS BIGINT) AS n_success,
    sum(lostwalltime) AS walltime_loss, min(endtime) AS a, max(endtime) AS b
  FROM held h JOIN signed s ON s.pandaid = h.pandaid GROUP BY h.slice, h.number),
found AS (
  SELECT m.slice AS signature, m.number AS set_number, features, n_failed, n_success, walltime_loss,
    round(n_failed / (n_failed + n_success), 6) AS purity,
    CASE WHEN a = b THEN a - INTERVAL 10 MINUTE ELSE a END AS window_start,
    CASE WHEN a = b THEN b + INTERVAL 10 MINUTE ELSE b END AS window_end
  FROM measured m JOIN sets s ON s.slice = m.slice AND s.number = m.number)"""
)

# The issue list that the queries on given issues work with.
LIST = """
failed_jobs AS (
  SELECT endtime, computingsite AS site, coalesce(destinationse, 'Not specified') AS se,
    CAST(substr(computingsite, 6) AS BIGINT) + 1 AS n, coalesce(TRY_CAST(substr(destinationse, 4) AS BIGINT), 9) AS m
  FROM jobs WHERE jobstatus = 'failed'),
issue_list AS (
  SELECT n AS issue_id, site, CAST(NULL AS VARCHAR) AS se, min(endtime) AS window_start, max(endtime) - INTERVAL 1 DAY AS window_end
  FROM failed_jobs GROUP BY n, site
  UNION ALL
  SELECT n * 100 + m, site, se, min(endtime), max(endtime) - INTERVAL 1 DAY FROM failed_jobs GROUP BY n, m, site, se),
labelled AS (
  SELECT *, 'COMPUTINGSITE=' || site || CASE WHEN se IS NULL THEN '' ELSE ',DESTINATIONSE=' || se END AS features FROM issue_list)"""
LISTED = (
    PREPARED
    + ","
    + LIST
    + """,
issue_jobs AS (
  SELECT i.issue_id, s.* EXCLUDE (site), s.site FROM signed s JOIN issue_list i
  ON s.computingsite = i.site AND (i.se IS NULL OR s.destinationse = i.se) AND s.endtime BETWEEN i.window_start AND i.window_end),
metrics AS (
  SELECT issue_id, CAST(sum(isfailed) AS BIGINT) AS n_failed, CAST(sum(issuccess) AS BIGINT) AS n_success,
    sum(lostwalltime) AS walltime_loss, min(endtime) AS a, max(endtime) AS b FROM issue_jobs GROUP BY issue_id)"""
)
OVERLAP = (
    LISTED
    + """,
failing AS (SELECT issue_id, pandaid FROM issue_jobs WHERE isfailed = 1),
totals AS (SELECT issue_id, count(*) AS n FROM failing GROUP BY issue_id),
overlap AS (
  SELECT a.issue_id, b.issue_id AS other_id, count(*) AS n_shared, any_value(t.n) AS n_own, any_value(u.n) AS n_other
  FROM failing a JOIN failing b ON a.pandaid = b.pandaid AND a.issue_id <> b.issue_id
  JOIN totals t ON t.issue_id = a.issue_id JOIN totals u ON u.issue_id = b.issue_id
  GROUP BY a.issue_id, b.issue_id HAVING count(*) / any_value(t.n) > 0.3)"""
)
# Issues of one or two features are similar if they share any of them.
GROUPS = """,
feature AS (
  SELECT issue_id, 'COMPUTINGSITE' AS k, site AS v FROM issue_list
  UNION ALL SELECT issue_id, 'DESTINATIONSE', se FROM issue_list WHERE se IS NOT NULL),
edge AS (SELECT DISTINCT a.issue_id AS x, b.issue_id AS y FROM feature a JOIN feature b ON a.k = b.k AND a.v = b.v),
reach AS (
  SELECT issue_id AS x, issue_id AS y FROM issue_list
  UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
groups AS (SELECT x AS issue_id, min(y) AS group_id FROM reach GROUP BY x)"""

_V = "jobs tasks"
SQL = {
    "lost_walltime": oracle(
        "jobs",
        f"""SELECT pandaid, CASE WHEN jobstatus = 'failed' THEN 0 ELSE 1 END AS issuccess,
  CASE WHEN jobstatus = 'failed' THEN 1 ELSE 0 END AS isfailed, CAST({_LOST} AS DOUBLE) AS lostwalltime FROM jobs""",
    ),
    "feature_select": oracle(
        _V, PREPARED + " SELECT pandaid, computingsite, destinationse, jeditaskid, site FROM prepared"
    ),
    "job_scan": oracle(
        _V,
        """SELECT pandaid, j.jeditaskid, jobstatus, endtime, site FROM jobs j JOIN tasks t ON t.jeditaskid = j.jeditaskid
WHERE jobstatus IN ('failed', 'finished') AND endtime IS NOT NULL
  AND endtime > TIMESTAMP '2024-01-10 00:00:00' AND starttime < TIMESTAMP '2024-01-20 00:00:00'""",
    ),
    "job_scan_managed": oracle(
        _V,
        """SELECT pandaid, j.jeditaskid, 'managed' AS prodsourcelabel, endtime + (pandaid % 5 - 2) * INTERVAL 1 DAY AS modificationtime, site
FROM jobs j JOIN tasks t ON t.jeditaskid = j.jeditaskid
WHERE pandaid % 3 <> 0 AND endtime + (pandaid % 5 - 2) * INTERVAL 1 DAY > TIMESTAMP '2024-01-10 00:00:00'
  AND endtime > TIMESTAMP '2024-01-10 00:00:00' AND starttime < TIMESTAMP '2024-01-20 00:00:00'""",
    ),
    "order_lines": """SELECT o_orderpriority, l_returnflag, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "trailing_window": oracle(
        "jobs",
        "SELECT pandaid, endtime FROM jobs WHERE endtime >= (SELECT max(endtime) FROM jobs) - INTERVAL 12 HOUR",
    ),
    "error_hash": oracle(
        "jobs", "SELECT pandaid, substr(sha1(CAST(piloterrorcode AS VARCHAR)), 1, 6) AS code_hash FROM jobs"
    ),
    "error_signature": oracle(
        _V, PREPARED + " SELECT pandaid, ddmerrordiag, piloterrordiag, piloterrorcode, combinederrors FROM signed"
    ),
    "signature_frequency": oracle(_V, FREQUENCY + " SELECT * FROM frequency"),
    "top_signatures": oracle(_V, FREQUENCY + _top(2) + " SELECT * FROM windows"),
    "signature_slice": oracle(
        _V,
        SLICE
        + """ SELECT slice, computingsite, count(*) AS n, CAST(sum(pandaid) AS BIGINT) AS ids,
  CAST(sum(isfailed) AS BIGINT) AS n_failed FROM slices GROUP BY slice, computingsite""",
    ),
    "signature_slice_rows": oracle(_V, SLICE + " SELECT slice, pandaid FROM slices"),
    "slice_cells": oracle(
        _V,
        SLICE
        + """ SELECT slice, computingsite, destinationse, jeditaskid, CAST(sum(isfailed) AS BIGINT) AS n_failed,
  CAST(sum(issuccess) AS BIGINT) AS n_success, sum(lostwalltime) AS walltime_loss, min(endtime) AS first_end, max(endtime) AS last_end
  FROM slices GROUP BY slice, computingsite, destinationse, jeditaskid""",
    ),
    "feature_scores": oracle(
        _V,
        SCORES
        + """ SELECT slice, feature, value, f AS n_failed, s AS n_success, walltime_loss, round(gain, 5) AS gain,
  round(lift, 5) AS lift, round(importance, 5) AS importance FROM scores""",
    ),
    "important_values": oracle(
        _V, SCORES + " SELECT slice, feature, value, round(importance, 5) AS importance, number FROM important"
    ),
    "feature_pairs": oracle(_V, PAIRS + " SELECT * FROM pairs"),
    "feature_sets": oracle(_V, SETS + " SELECT slice, number, features FROM sets"),
    "error_strings": oracle(
        _V,
        SLICE
        + """, own AS (SELECT w.combinederrors AS slice, ddmerrordiag, piloterrordiag FROM signed s
  JOIN windows w ON s.combinederrors = w.combinederrors AND s.endtime BETWEEN w.window_start AND w.window_end)
SELECT slice, 'DDMERRORDIAG' AS field, min(ddmerrordiag) AS text, count(*) AS n FROM own GROUP BY slice HAVING min(ddmerrordiag) <> 'Not specified'
UNION ALL SELECT slice, 'PILOTERRORDIAG', min(piloterrordiag), count(*) FROM own GROUP BY slice HAVING min(piloterrordiag) <> 'Not specified'""",
    ),
    "find_issues": oracle(_V, ISSUES + " SELECT * FROM found"),
    "issue_list": oracle("jobs", LIST.strip() + " SELECT issue_id, features, window_start, window_end FROM labelled"),
    "issue_rows": oracle(_V, LISTED + " SELECT issue_id, pandaid FROM issue_jobs"),
    "issue_antirows": oracle(
        _V,
        LISTED
        + """, one AS (SELECT * FROM issue_list ORDER BY issue_id DESC LIMIT 1)
SELECT o.issue_id, s.pandaid FROM signed s JOIN one o ON s.endtime BETWEEN o.window_start AND o.window_end
WHERE NOT (s.computingsite = o.site AND s.destinationse = o.se)""",
    ),
    "issue_metrics": oracle(
        _V,
        LISTED
        + """ SELECT issue_id, n_failed, n_success, walltime_loss, round(n_failed / (n_failed + n_success), 6) AS purity,
  CASE WHEN a = b THEN a - INTERVAL 10 MINUTE ELSE a END AS window_start,
  CASE WHEN a = b THEN b + INTERVAL 10 MINUTE ELSE b END AS window_end FROM metrics""",
    ),
    "payload_class": oracle(
        _V,
        LISTED
        + """ SELECT issue_id, bool_or(site <> 'Not specified') AS is_hpc, bool_or(site = 'Not specified') AS is_grid,
  CASE WHEN bool_or(site <> 'Not specified') AND bool_or(site = 'Not specified') THEN 1
    WHEN bool_or(site <> 'Not specified') THEN 2 ELSE 0 END AS payload_type FROM issue_jobs GROUP BY issue_id""",
    ),
    "issue_overlap": oracle(_V, OVERLAP + " SELECT * FROM overlap"),
    "shared_failed_jobs": oracle(
        _V,
        OVERLAP
        + """ SELECT pandaid FROM failing WHERE issue_id = 4 INTERSECT SELECT pandaid FROM failing WHERE issue_id = 403""",
    ),
    "issue_reduce": oracle(
        _V,
        OVERLAP
        + """ SELECT issue_id, features FROM labelled
  WHERE issue_id NOT IN (SELECT issue_id FROM overlap WHERE n_own < n_other)""",
    ),
    "similar_issues": oracle("jobs", LIST.strip() + GROUPS + " SELECT issue_id, group_id FROM groups"),
    "merge_issues": oracle(
        _V,
        LISTED
        + GROUPS
        + """,
member AS (
  SELECT g.group_id, l.issue_id, l.features, l.window_start, l.window_end, m.n_failed, m.n_success, m.walltime_loss
  FROM labelled l JOIN metrics m ON m.issue_id = l.issue_id JOIN groups g ON g.issue_id = l.issue_id),
error AS (
  SELECT group_id, 'PILOTERRORDIAG' AS field, 'code ' || (issue_id % 3) AS t, n_failed AS n FROM member
  UNION ALL SELECT group_id, 'DDMERRORDIAG', 'stage-out failed', n_success FROM member),
summed AS (SELECT group_id, field, t, CAST(sum(n) AS BIGINT) AS n FROM error GROUP BY ALL),
per_field AS (SELECT group_id, field, string_agg(t || '=' || n, '/' ORDER BY t) AS texts FROM summed GROUP BY ALL),
texts AS (SELECT group_id, string_agg(field || ':' || texts, ',' ORDER BY field) AS errors FROM per_field GROUP BY group_id),
merged AS (
  SELECT group_id AS issue_id, first(features ORDER BY n_failed DESC, issue_id) AS features, CAST(sum(n_failed) AS BIGINT) AS n_failed,
    CAST(sum(n_success) AS BIGINT) AS n_success, sum(walltime_loss) AS walltime_loss,
    round(sum(n_failed) / (sum(n_failed) + sum(n_success)), 6) AS purity, min(window_start) AS window_start,
    max(window_end) AS window_end, count(*) AS n_merged FROM member GROUP BY group_id)
SELECT m.*, errors FROM merged m JOIN texts t ON t.group_id = m.issue_id""",
    ),
    "unique_issues": oracle("jobs", LIST.strip() + " SELECT issue_id, features FROM labelled"),
    "merged_error_counts": oracle(
        _V,
        SLICE
        + """, own AS (SELECT ddmerrordiag, piloterrordiag FROM signed s
  JOIN windows w ON s.combinederrors = w.combinederrors AND s.endtime BETWEEN w.window_start AND w.window_end),
per_text AS (SELECT 'DDMERRORDIAG' AS field, ddmerrordiag AS text FROM own UNION ALL SELECT 'PILOTERRORDIAG', piloterrordiag FROM own)
SELECT 'all' AS all_slices, field, text, count(*) AS n FROM per_text WHERE text <> 'Not specified' GROUP BY field, text""",
    ),
    "failure_ticks": oracle(
        _V,
        LISTED
        + """,
tick AS (
  SELECT j.issue_id, time_bucket(INTERVAL 15 MINUTE, endtime) AS tick_time, sum(lostwalltime) AS walltime_loss, count(*) AS nfailed_jobs
  FROM issue_jobs j JOIN issue_list i ON i.issue_id = j.issue_id
  WHERE isfailed = 1 AND endtime > i.window_start AND endtime < i.window_end GROUP BY ALL),
span AS (SELECT issue_id, min(tick_time) AS a, max(tick_time) AS b FROM tick GROUP BY issue_id),
grid AS (SELECT issue_id, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS tick_time FROM span)
SELECT g.issue_id, g.tick_time, coalesce(walltime_loss, 0.0) AS walltime_loss, coalesce(nfailed_jobs, 0) AS nfailed_jobs
FROM grid g LEFT JOIN tick t ON t.issue_id = g.issue_id AND t.tick_time = g.tick_time""",
    ),
    "job_analysis": oracle(
        _V,
        ISSUES
        + """,
columns AS (
  SELECT m.slice, m.number, max(value) FILTER (feature = 'COMPUTINGSITE') AS c1,
    max(value) FILTER (feature = 'DESTINATIONSE') AS c2, max(value) FILTER (feature = 'JEDITASKID') AS c3
  FROM members m JOIN important i ON i.slice = m.slice AND i.number = m.member GROUP BY m.slice, m.number),
issue AS (
  SELECT row_number() OVER (ORDER BY signature, set_number) AS issue_id, f.*, c1, c2, c3
  FROM found f JOIN columns c ON c.slice = f.signature AND c.number = f.set_number),
failing AS (
  SELECT i.issue_id, s.pandaid FROM signed s JOIN issue i ON (c1 IS NULL OR s.computingsite = c1)
    AND (c2 IS NULL OR s.destinationse = c2) AND (c3 IS NULL OR s.jeditaskid = c3)
    AND s.endtime BETWEEN i.window_start AND i.window_end WHERE s.isfailed = 1),
total AS (SELECT issue_id, count(*) AS n FROM failing GROUP BY issue_id),
covered AS (
  SELECT a.issue_id FROM failing a JOIN failing b ON a.pandaid = b.pandaid AND a.issue_id <> b.issue_id
  JOIN total t ON t.issue_id = a.issue_id JOIN total u ON u.issue_id = b.issue_id
  GROUP BY a.issue_id, b.issue_id HAVING count(*) / any_value(t.n) > 0.3 AND any_value(t.n) < any_value(u.n)),
kept AS (SELECT * FROM issue WHERE issue_id NOT IN (SELECT issue_id FROM covered)),
trait AS (
  SELECT issue_id, 1 AS k, c1 AS v FROM kept WHERE c1 IS NOT NULL UNION ALL SELECT issue_id, 2, c2 FROM kept WHERE c2 IS NOT NULL
  UNION ALL SELECT issue_id, 3, c3 FROM kept WHERE c3 IS NOT NULL),
edge AS (SELECT DISTINCT a.issue_id AS x, b.issue_id AS y FROM trait a JOIN trait b ON a.k = b.k AND a.v = b.v),
reach AS (SELECT issue_id AS x, issue_id AS y FROM kept UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
groups AS (SELECT x AS issue_id, min(y) AS group_id FROM reach GROUP BY x),
merged AS (
  SELECT group_id, first(struct_pack(f := features, c1 := c1, c2 := c2, c3 := c3) ORDER BY n_failed DESC, k.issue_id) AS top,
    CAST(sum(n_failed) AS BIGINT) AS n_failed, CAST(sum(n_success) AS BIGINT) AS n_success, sum(walltime_loss) AS walltime_loss,
    min(window_start) AS window_start, max(window_end) AS window_end, count(*) AS n_merged
  FROM kept k JOIN groups g ON g.issue_id = k.issue_id GROUP BY group_id),
merged_jobs AS (
  SELECT m.group_id, s.site, s.isfailed, s.endtime, s.endtime > m.window_start AND s.endtime < m.window_end AS strict
  FROM merged m JOIN signed s ON (m.top.c1 IS NULL OR s.computingsite = m.top.c1) AND (m.top.c2 IS NULL OR s.destinationse = m.top.c2)
    AND (m.top.c3 IS NULL OR s.jeditaskid = m.top.c3) AND s.endtime BETWEEN m.window_start AND m.window_end),
payload AS (
  SELECT group_id, CASE WHEN bool_or(site <> 'Not specified') AND bool_or(site = 'Not specified') THEN 1
    WHEN bool_or(site <> 'Not specified') THEN 2 ELSE 0 END AS payload_type FROM merged_jobs GROUP BY group_id),
ticks AS (
  SELECT group_id, count(*) AS tick_failures,
    (epoch_us(time_bucket(INTERVAL 15 MINUTE, max(endtime))) - epoch_us(time_bucket(INTERVAL 15 MINUTE, min(endtime)))) // 900000000 + 1 AS n_ticks
  FROM merged_jobs WHERE isfailed = 1 AND strict GROUP BY group_id)
SELECT m.group_id AS issue_id, m.top.f AS features, n_failed, n_success, walltime_loss, round(n_failed / (n_failed + n_success), 6) AS purity,
  window_start, window_end, n_merged, payload_type, n_ticks, tick_failures
FROM merged m LEFT JOIN payload p ON p.group_id = m.group_id LEFT JOIN ticks t ON t.group_id = m.group_id""",
    ),
}
SQL["find_issues_fine"] = oracle(
    _V,
    ISSUES.replace("importance > 5", "importance > 1")
    + """ SELECT row_number() OVER (ORDER BY signature, set_number) AS issue_id, signature, features,
  n_failed, n_success, walltime_loss FROM found""",
)
SQL["job_analysis_fine"] = SQL["job_analysis"].replace("importance > 5", "importance > 1")
SQL["job_cycle"] = (
    SQL["job_analysis"].rsplit("SELECT m.group_id AS issue_id", 1)[0]
    + """SELECT CAST(2 AS BIGINT) AS session_id, m.group_id AS issue_id, window_start AS observation_started, window_end AS observation_finished,
  n_failed AS nfailed_jobs, n_success AS nsuccess_jobs, payload_type, CAST((m.top.c1 IS NOT NULL)::INT + (m.top.c2 IS NOT NULL)::INT + (m.top.c3 IS NOT NULL)::INT AS BIGINT) AS n_features, n_ticks, tick_failures,
  CAST(1 AS BIGINT) AS n_sessions
FROM merged m LEFT JOIN payload p ON p.group_id = m.group_id LEFT JOIN ticks t ON t.group_id = m.group_id"""
)
