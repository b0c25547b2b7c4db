"""Queries over the issue store."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import values
from faultscope.operators import quality as qua
from faultscope.operators import report as rep
from faultscope.plans import issue_report as plan
from faultscope.session import scratch_path
from faultscope.sources import stores
from workload import fixtures as fix
from workload.fixtures import oracle

FROM = datetime.datetime(2024, 1, 5)
TO = datetime.datetime(2024, 1, 25)


def _report(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    return plan.issue_report(
        fix.issues(spark, folder), fix.issue_meta(spark, folder), fix.issue_ticks(spark, folder), FROM, TO, **options
    )


def issue_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = rep.overlapping_issues(fix.issues(spark, folder), FROM, TO, "hpc")
    return found.select("issue_id", "observation_started", "observation_finished")


def issue_features(spark: SparkSession, folder: str) -> DataFrame:
    found = rep.issue_features(fix.issues(spark, folder), fix.issue_meta(spark, folder))
    return found.select("issue_id", values.canonical_map(F.col("features")).alias("features_key"))


def observation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    observed = rep.observations(fix.issues(spark, folder), fix.issue_ticks(spark, folder))
    return rep.observation_rollup(observed).withColumn("walltime_loss", F.col("walltime_loss").cast("double"))


def merged_issues(spark: SparkSession, folder: str) -> DataFrame:
    found = rep.issue_features(fix.issues(spark, folder), fix.issue_meta(spark, folder))
    ticks = rep.merged_observations(found, fix.issue_ticks(spark, folder))
    merged = rep.merge_by_features(found, ticks)
    return merged.withColumn("walltime_loss", F.col("walltime_loss").cast("double"))


def issue_report(spark: SparkSession, folder: str) -> DataFrame:
    top, _ = _report(spark, folder, top_n=5)
    return top.select(
        "name", "issue_id", "err_messages", F.col("walltime_loss").cast("double").alias("walltime_loss"),
        "nfailed_jobs", "observation_started", "observation_finished",
    )


def issue_report_fails(spark: SparkSession, folder: str) -> DataFrame:
    top, _ = _report(spark, folder, top_n=3, metric="fails", compute_type="grid")
    return top.select("name", "issue_id", "nfailed_jobs")


def issue_histogram(spark: SparkSession, folder: str) -> DataFrame:
    _, histogram = _report(spark, folder, top_n=5)
    return histogram.withColumn("walltime_loss", F.col("walltime_loss").cast("double"))


def _sessions(issues: DataFrame) -> DataFrame:
    """One finished session per day, the last one still open."""
    days = issues.select(F.dayofmonth("observation_started").alias("day")).distinct()
    last = days.agg(F.max("day")).scalar()
    return days.select(
        F.col("day").alias("session_id"),
        F.when(F.col("day") != last, F.current_timestamp()).alias("analysis_finished"),
    )


def session_replace(spark: SparkSession, folder: str) -> DataFrame:
    issues = fix.issues(spark, folder).withColumn("session_id", F.dayofmonth("observation_started"))
    return stores.latest_session(issues, _sessions(issues)).select("issue_id", "session_id")


def retention(spark: SparkSession, folder: str) -> DataFrame:
    kept = stores.retained_issues(fix.issues(spark, folder), FROM)
    ticks = stores.retained_children(fix.issue_ticks(spark, folder), kept)
    return ticks.groupBy("issue_id").agg(F.count("*").alias("n_ticks"))


def retention_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What a stored tree of issues holds after the late ones are deleted, in all its tables; a child without its issue would be a row."""
    path = scratch_path(spark, "retention")
    session = F.floor(F.col("issue_id") / 300).cast("bigint")
    tables = {"issues": fix.issues, "issue_meta": fix.issue_meta, "issue_ticks": fix.issue_ticks}
    stores.write_tables({name: rows(spark, folder).withColumn("session_id", session) for name, rows in tables.items()}, path)
    stores.delete_issues(spark, path, FROM)
    left = stores.read_issue_store(spark, path)
    counted = left["issues"].select("issue_id", "session_id", "observation_started")
    for name, count in (("issue_ticks", "n_ticks"), ("issue_meta", "n_features")):
        counted = counted.join(left[name].groupBy("issue_id").agg(F.count("*").alias(count)), "issue_id", "full_outer")
    return counted


def issue_store(spark: SparkSession, folder: str) -> DataFrame:
    """Issues written to the store and read back."""
    base = rep.issue_features(fix.issues(spark, folder), fix.issue_meta(spark, folder))
    rollup = rep.observation_rollup(fix.issue_ticks(spark, folder))
    issues = base.join(rollup.select("issue_id", "walltime_loss", "nfailed_jobs"), "issue_id").select(
        "issue_id",
        "features",
        F.col("observation_started").alias("window_start"),
        F.col("observation_finished").alias("window_end"),
        F.col("walltime_loss").cast("double").alias("walltime_loss"),
        F.col("nfailed_jobs").alias("n_failed"),
        F.lit(0).cast("bigint").alias("n_success"),
        "payload_type",
        F.create_map(F.lit("PILOTERRORDIAG"), F.create_map("err_messages", "nfailed_jobs")).alias("error_strings"),
    )
    path = scratch_path(spark, "issue-store")
    stores.write_issue_store(issues, fix.issue_ticks(spark, folder), path, session_id=7)
    tables = stores.read_issue_store(spark, path)
    features = tables["issue_meta"].groupBy("issue_id").agg(F.count("*").alias("n_features"))
    ticks = tables["issue_ticks"].groupBy("issue_id").agg(F.count("*").alias("n_ticks"))
    return (
        tables["issues"]
        .join(features, "issue_id")
        .join(ticks, "issue_id")
        .withColumn("session_id", F.col("session_id").cast("bigint"))
    )


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """Issues as JSON lines, read back as text and parsed."""
    path = scratch_path(spark, "issue-report")
    stores.write_json_report(
        fix.issues(spark, folder).select("issue_id", "observation_started", "err_messages"), path
    )
    return spark.read.text(path).select(
        F.get_json_object("value", "$.issue_id").cast("bigint").alias("issue_id"),
        F.get_json_object("value", "$.observation_started").alias("started"),
        F.get_json_object("value", "$.err_messages").alias("err_messages"),
    )


def iso_json(spark: SparkSession, folder: str) -> DataFrame:
    return fix.issues(spark, folder).select(
        "issue_id", values.iso_json(F.struct("issue_id", "observation_started")).alias("json")
    )


def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return qua.key_violations(fix.issue_meta(spark, folder), ["key", "value"])


def choice_violations(spark: SparkSession, folder: str) -> DataFrame:
    return qua.choice_violations(fix.table(spark, folder, "events"), "event_type", ["click", "view", "error"])


def constraint_run(spark: SparkSession, folder: str) -> DataFrame:
    """All declared keys, choices and references of tables with repeated, odd and lost rows."""
    issues = fix.issues(spark, folder).withColumn("session_id", F.dayofmonth("observation_started"))
    log = fix.messages(spark, folder)
    transfers = log.select(
        F.col("msg_id").alias("id"),
        F.regexp_replace("t__error_message", "[0-9]+", "#").alias("message"),
        F.col("tr_error_category").alias("type"),
        F.when(F.col("msg_id") % 5 == 0, "Closed").otherwise("New").alias("status"),
        (F.col("msg_id") % 30).alias("category"),
    )
    shifted = F.col("issue_id") + 1
    return qua.check_constraints(
        {
            "sessions": issues.filter("session_id % 6 <> 0").select("session_id").distinct(),
            "workflow_issue": issues,
            "workflow_issue_metadata": fix.issue_meta(spark, folder).withColumn("issue_id", shifted),
            "workflow_issue_ticks": fix.issue_ticks(spark, folder).withColumn("issue_id", shifted),
            "transfer_issue": transfers,
            "issue_category": fix.table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.substring("url", 1, 16).alias("regex")).filter("id % 7 <> 0"),
            "site_pair": fix.transfers(spark, folder).select("src_site", "dst_site"),
            "issue_metadata": fix.issue_meta(spark, folder),
        }
    )


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    ticks = fix.issue_ticks(spark, folder).withColumn("issue_id", (F.col("issue_id") + 1).cast("bigint"))
    return qua.orphans(ticks, "issue_id", fix.issues(spark, folder), "issue_id").select(
        "issue_id", "tick_time", "nfailed_jobs"
    )


QUERIES = {
    f.__name__: f
    for f in (
        issue_filter, issue_features, observation_rollup, merged_issues, issue_report,
        issue_report_fails, issue_histogram, session_replace, retention, retention_delete, issue_store, json_report,
        iso_json, key_violations, choice_violations, orphans, constraint_run,
    )
}

# -- SQL ------------------------------------------------------------------------------------


def _top(limit: int, metric: str = "walltime_loss", payload: str = "") -> str:
    return f"""
chosen AS (
  SELECT i.* FROM issues i WHERE observation_started < TIMESTAMP '2024-01-25 00:00:00'
    AND observation_finished > TIMESTAMP '2024-01-05 00:00:00' {payload}),
keyed AS (
  SELECT c.issue_id, any_value(err_messages) AS err_messages, string_agg(key || '=' || value, ',' ORDER BY key) AS k
  FROM chosen c JOIN issue_meta m ON m.issue_id = c.issue_id GROUP BY c.issue_id),
active AS (
  SELECT * FROM keyed WHERE issue_id IN (SELECT issue_id FROM issue_ticks GROUP BY issue_id HAVING sum(nfailed_jobs) > 0)),
merged_ticks AS (
  SELECT k, tick_time, CAST(arg_max(walltime_loss, t.issue_id) AS DOUBLE) AS walltime_loss,
    arg_max(nfailed_jobs, t.issue_id) AS nfailed_jobs
  FROM active a JOIN issue_ticks t ON t.issue_id = a.issue_id GROUP BY k, tick_time),
heads AS (SELECT k, max(issue_id) AS issue_id, arg_min(err_messages, issue_id) AS err_messages, count(*) AS n_merged FROM active GROUP BY k),
sums AS (
  SELECT k, CAST(sum(CAST(walltime_loss AS DECIMAL(18,2))) AS DOUBLE) AS walltime_loss, CAST(sum(nfailed_jobs) AS BIGINT) AS nfailed_jobs,
    min(tick_time) AS observation_started, max(tick_time) AS observation_finished FROM merged_ticks GROUP BY k),
top AS (
  SELECT 'N_' || (row_number() OVER (ORDER BY {metric} DESC, issue_id) - 1) AS name, h.*, s.* EXCLUDE (k)
  FROM heads h JOIN sums s ON s.k = h.k ORDER BY {metric} DESC, issue_id LIMIT {limit})"""


_JSON_KEY = """'[' || string_agg('{"key":"' || key || '","value":"' || value || '"}', ',' ORDER BY key) || ']'"""
_S = "issue_ticks issues issue_meta"
SQL = {
    "issue_filter": oracle(
        "issues",
        """SELECT issue_id, observation_started, observation_finished FROM issues
WHERE observation_started < TIMESTAMP '2024-01-25 00:00:00' AND observation_finished > TIMESTAMP '2024-01-05 00:00:00' AND payload_type = 2""",
    ),
    "issue_features": oracle("issue_meta", f"SELECT issue_id, {_JSON_KEY} AS features_key FROM issue_meta GROUP BY issue_id"),
    "observation_rollup": oracle(
        "issue_ticks",
        """SELECT issue_id, CAST(sum(walltime_loss) AS DOUBLE) AS walltime_loss, CAST(sum(nfailed_jobs) AS BIGINT) AS nfailed_jobs,
  min(tick_time) AS observation_started, max(tick_time) AS observation_finished FROM issue_ticks GROUP BY issue_id HAVING sum(nfailed_jobs) > 0""",
    ),
    "merged_issues": oracle(
        _S,
        _top(1000000).replace("observation_started < TIMESTAMP '2024-01-25 00:00:00'", "true").replace(
            "observation_finished > TIMESTAMP '2024-01-05 00:00:00'", "true")
        + f""",
json AS (SELECT issue_id, {_JSON_KEY} AS features_key FROM issue_meta GROUP BY issue_id)
SELECT features_key, t.issue_id, err_messages, n_merged, walltime_loss, nfailed_jobs, observation_started, observation_finished
FROM top t JOIN json j ON j.issue_id = t.issue_id""",
    ),
    "issue_report": oracle(
        _S,
        _top(5)
        + " SELECT name, issue_id, err_messages, walltime_loss, nfailed_jobs, observation_started, observation_finished FROM top",
    ),
    "issue_report_fails": oracle(
        _S, _top(3, "nfailed_jobs", "AND payload_type = 0") + " SELECT name, issue_id, nfailed_jobs FROM top"
    ),
    "issue_histogram": oracle(
        _S,
        _top(5)
        + """,
shown AS (SELECT m.* FROM merged_ticks m JOIN top t ON t.k = m.k),
grid AS (SELECT name, issue_id, t.k, x.tick_time FROM top t CROSS JOIN (SELECT DISTINCT tick_time FROM shown) x)
SELECT name, issue_id, g.tick_time, coalesce(walltime_loss, 0.0) AS walltime_loss, coalesce(nfailed_jobs, 0) AS nfailed_jobs
FROM grid g LEFT JOIN shown s ON s.k = g.k AND s.tick_time = g.tick_time""",
    ),
    "session_replace": oracle(
        "issues",
        """session AS (SELECT DISTINCT day(observation_started) AS d FROM issues)
SELECT issue_id, CAST(day(observation_started) AS INTEGER) AS session_id FROM issues
WHERE day(observation_started) = (SELECT max(d) FROM session WHERE d < (SELECT max(d) FROM session))""",
    ),
    "retention": oracle(
        "issues",
        """SELECT t.issue_id, count(*) AS n_ticks FROM issue_ticks t JOIN issues i ON i.issue_id = t.issue_id
WHERE observation_started <= TIMESTAMP '2024-01-05 00:00:00' GROUP BY t.issue_id""",
    ),
    "retention_delete": oracle(
        "issues issue_meta",
        """SELECT issue_id, issue_id // 300 AS session_id, observation_started,
  (SELECT count(*) FROM issue_ticks t WHERE t.issue_id = i.issue_id) AS n_ticks,
  (SELECT count(*) FROM issue_meta m WHERE m.issue_id = i.issue_id) AS n_features
FROM issues i WHERE observation_started <= TIMESTAMP '2024-01-05 00:00:00'""",
    ),
    "issue_store": oracle(
        _S,
        """sums AS (SELECT issue_id, CAST(sum(walltime_loss) AS DOUBLE) AS walltime_loss, CAST(sum(nfailed_jobs) AS BIGINT) AS nfailed_jobs,
  count(*) AS n_ticks FROM issue_ticks GROUP BY issue_id),
traits AS (SELECT issue_id, count(*) AS n_features FROM issue_meta GROUP BY issue_id)
SELECT i.issue_id, CAST(7 AS BIGINT) AS session_id, observation_started, observation_finished, walltime_loss, nfailed_jobs,
  CAST(0 AS BIGINT) AS nsuccess_jobs, payload_type, '{"PILOTERRORDIAG":{"' || err_messages || '":' || nfailed_jobs || '}}' AS err_messages,
  n_features, n_ticks
FROM issues i JOIN sums s ON s.issue_id = i.issue_id JOIN traits t ON t.issue_id = i.issue_id""",
    ),
    "json_report": oracle(
        "issues",
        "SELECT issue_id, strftime(observation_started, '%Y-%m-%dT%H:%M:%S.%f') AS started, err_messages FROM issues",
    ),
    "iso_json": oracle(
        "issues",
        """SELECT issue_id, '{"issue_id":' || issue_id || ',"observation_started":"' || strftime(observation_started, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS json FROM issues""",
    ),
    "key_violations": oracle(
        "issue_meta", "SELECT key, value, count(*) AS n_rows FROM issue_meta GROUP BY key, value HAVING count(*) > 1"
    ),
    "choice_violations": """SELECT event_type, count(*) AS n_rows FROM events
WHERE event_type NOT IN ('click', 'view', 'error') GROUP BY event_type""",
    "constraint_run": oracle(
        "issues issue_meta messages transfers",
        """ti AS (SELECT msg_id AS id, regexp_replace(t__error_message, '[0-9]+', '#', 'g') AS message, tr_error_category AS type,
  CASE WHEN msg_id % 5 = 0 THEN 'Closed' ELSE 'New' END AS status, msg_id % 30 AS category FROM messages),
cat AS (SELECT page_id AS id, substr(url, 1, 16) AS regex FROM pages WHERE page_id % 7 <> 0),
ses AS (SELECT DISTINCT day(observation_started) AS session_id FROM issues WHERE day(observation_started) % 6 <> 0)
SELECT 'key' AS kind, 'issue_category' AS "table", 'regex' AS columns, count(*) AS n_violations FROM (SELECT 1 FROM cat GROUP BY regex HAVING count(*) > 1)
UNION ALL SELECT 'key', 'transfer_issue', 'message,type', count(*) FROM (SELECT 1 FROM ti GROUP BY message, type HAVING count(*) > 1)
UNION ALL SELECT 'key', 'site_pair', 'src_site,dst_site', count(*) FROM (SELECT 1 FROM transfers GROUP BY src_site, dst_site HAVING count(*) > 1)
UNION ALL SELECT 'key', 'issue_metadata', 'issue_id,key,value', count(*) FROM (SELECT 1 FROM issue_meta GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'choice', 'transfer_issue', 'status', count(*) FROM (SELECT DISTINCT status FROM ti WHERE status NOT IN ('New', 'Ongoing', 'Resolved'))
UNION ALL SELECT 'reference', 'transfer_issue', 'category', count(*) FROM ti WHERE category NOT IN (SELECT id FROM cat)
UNION ALL SELECT 'reference', 'issue_metadata', 'issue_id', count(*) FROM issue_meta WHERE issue_id NOT IN (SELECT id FROM ti)
UNION ALL SELECT 'reference', 'workflow_issue', 'session_id', count(*) FROM issues WHERE day(observation_started) NOT IN (SELECT session_id FROM ses)
UNION ALL SELECT 'reference', 'workflow_issue_metadata', 'issue_id', count(*) FROM issue_meta WHERE issue_id + 1 NOT IN (SELECT issue_id FROM issues)
UNION ALL SELECT 'reference', 'workflow_issue_ticks', 'issue_id', count(*) FROM issue_ticks WHERE issue_id + 1 NOT IN (SELECT issue_id FROM issues)""".replace(
            "FROM (SELECT 1 FROM issue_meta GROUP BY ALL", "FROM (SELECT 1 FROM issue_meta GROUP BY issue_id, key, value"),
    ),
    "orphans": oracle(
        "issues",
        """SELECT issue_id + 1 AS issue_id, tick_time, nfailed_jobs FROM issue_ticks
WHERE issue_id + 1 NOT IN (SELECT issue_id FROM issues)""",
    ),
}
