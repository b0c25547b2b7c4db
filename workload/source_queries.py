"""Queries that write files and read them back, in batch and as streams."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.operators import issues as iss
from faultscope.operators import jobs as job
from faultscope.operators import transfers as tra
from faultscope.plans import transfer_loading
from faultscope.session import scratch_path
from faultscope.sources import files
from faultscope.streaming import windows as stw
from faultscope.streaming.days import DayTable
from workload import fixtures as fix
from workload.fixtures import oracle

LOG_COLUMNS = [f.name for f in files.TRANSFER_FIELDS if f.name != "vo"]
TICK_COLUMNS = [
    "concat('SITE_', user_id % 8) AS computingsite",
    "ts AS ENDTIME",
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'finished' END AS JOBSTATUS",
    "CAST(value AS DECIMAL(18,2)) AS LOSTWALLTIME",
]
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = fix.messages(spark, folder).withColumn("timestamp_tr_comp", F.unix_millis("ts"))
    return rows.withColumn("day", F.date_format("ts", "yyyy/MM/dd"))


def _write_log(spark: SparkSession, folder: str) -> str:
    """The messages as JSON lines in one folder per day."""
    path = scratch_path(spark, "log")
    rows = _log(spark, folder).select(F.struct(*LOG_COLUMNS).alias("data"), "day")
    parts = F.split("day", "/")
    dated = rows.select("data", parts[0].alias("y"), parts[1].alias("m"), parts[2].alias("d"))
    dated.write.partitionBy("y", "m", "d").json(path)
    return path


def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "log")
    _log(spark, folder).select(F.struct(*LOG_COLUMNS).alias("data")).write.json(path)
    log = files.read_json(spark, [path]).select("data.*")
    return log.select("msg_id", "t__error_message", "timestamp_tr_comp")


def json_dir_scan(spark: SparkSession, folder: str) -> DataFrame:
    log = files.read_json_tree(spark, _write_log(spark, folder)).select("data.*")
    return log.select("msg_id", "src_hostname", "dst_site_name", "t_final_transfer_state_flag")


def day_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Two days of the log, read through their paths."""
    path = scratch_path(spark, "log")
    days = files.day_paths(path, datetime.date(2024, 1, 10), datetime.date(2024, 1, 11))
    log = _log(spark, folder)
    for day, target in zip(("2024/01/10", "2024/01/11"), days):
        log.filter(F.col("day") == day).select(F.struct(*LOG_COLUMNS).alias("data")).write.json(target)
    return files.read_json(spark, days).select("data.msg_id", "data.timestamp_tr_comp")


def typed_fetch(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    orders = fix.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    orders.write.orc(path)
    return files.fetch(spark, "ORC", path)


def fetch_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The same table by every type of file that ``fetch`` reads."""
    path = scratch_path(spark, "formats")
    orders = fix.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    schema = orders.schema
    found = []
    for kind, options in (("JSON", {}), ("parquet", {}), ("ORC", {}), ("CSV", {"header": "true"})):
        orders.write.options(**options).format(kind.lower()).save(f"{path}/{kind}")
        read = files.fetch(spark, kind, f"{path}/{kind}", schema if kind in ("JSON", "CSV") else None, **options)
        found.append(read.select(F.lit(kind).alias("format"), "o_orderkey", "o_orderpriority"))
    return functools.reduce(DataFrame.unionByName, found)


def snapshot_load(spark: SparkSession, folder: str) -> DataFrame:
    """A load that succeeds, then one whose source is gone and that falls back."""
    snapshot = scratch_path(spark, "snapshot")

    def translate(df: DataFrame) -> DataFrame:
        return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"))

    files.load_with_snapshot(spark, lambda: fix.table(spark, folder, "orders"), translate, snapshot)
    return files.load_with_snapshot(
        spark, lambda: spark.read.parquet(f"{snapshot}-missing"), translate, snapshot
    )


def registry_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The registry as one JSON text per site with two protocols, parsed again."""
    pages = fix.table(spark, folder, "pages")
    protocol = F.struct(F.concat(F.lit("p"), F.col("page_id") % 2).alias("name"), F.struct(F.col("url").alias("endpoint")).alias("body"))
    sites = pages.groupBy(F.concat(F.lit("SITE_"), F.floor(F.col("page_id") / 2)).alias("site")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(protocol))).alias("protocols")
    )
    path = scratch_path(spark, "registry")
    sites.write.json(path)
    endpoints = files.read_registry(spark, path)
    return files.host_sites(endpoints).groupBy("site").agg(F.count("*").alias("n_hosts")).agg(
        F.sum("n_hosts").alias("n_hosts")
    )


def registry_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The endpoints of both forms of the registry: protocols per site, and storage elements with protocols per site."""
    pages = fix.table(spark, folder, "pages")
    protocol = F.struct(F.concat(F.lit("p"), F.col("page_id") % 2).alias("name"), F.struct(F.col("url").alias("endpoint")).alias("body"))
    two = pages.groupBy(F.floor(F.col("page_id") / 2).alias("pair")).agg(F.map_from_entries(F.array_sort(F.collect_list(protocol))).alias("protocols"))
    plain = two.select(F.concat(F.lit("SITE_"), "pair").alias("site"), "protocols")
    # Two elements with two protocols each at most.
    grouped = two.groupBy(F.concat(F.lit("SITE_"), F.floor(F.col("pair") / 2)).alias("site")).agg(
        F.collect_list(F.struct("protocols")).alias("elements")
    )
    found = []
    for form, rows in (("protocols", plain), ("elements", grouped)):
        path = scratch_path(spark, "registry")
        rows.write.json(path)
        found.append(files.read_registry(spark, path, form == "elements").select(F.lit(form).alias("form"), "site", "endpoint"))
    return found[0].unionByName(found[1])


def load_days(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of one day of the log, from its folder."""
    base = scratch_path(spark, "log")
    day = datetime.date(2024, 1, 10)
    log = _log(spark, folder).filter(F.col("day") == "2024/01/10")
    log.select(F.struct(*LOG_COLUMNS).alias("data")).write.json(files.day_path(base, day))
    registry = files.host_sites(fix.site_registry(spark, folder))
    return transfer_loading.load_day(spark, base, day, registry)


# -- streams --------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stw.stream_files(spark, folder, spark.createDataFrame([], EVENTS).schema, pathGlobFilter="events.parquet")


def stream_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Failed jobs per site as a stream: the final state of all windows."""
    events = _event_stream(spark, folder).selectExpr(*TICK_COLUMNS)
    ticks = stw.failure_windows(stw.failed_jobs(events), ["computingsite"])
    path = scratch_path(spark, "ticks")
    stw.write_updates(ticks, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    final = stw.read_updates(spark, f"{path}/out", ["computingsite", "tick_time"])
    return final.withColumn("walltime_loss", F.col("walltime_loss").cast("double"))


def closed_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Failed jobs per site in windows that are over, in three batches: the second repeats the last hour of the first and a third of its
    own jobs, the last has jobs of the first days, which come too late. Read from the merged folders of some days."""
    path = scratch_path(spark, "closed-ticks")
    events = fix.table(spark, folder, "events").select(*[c.split()[0] for c in EVENTS.split(", ")])
    late = (F.col("event_id") % 50 == 7) & (F.col("ts") < "2024-01-05")
    first = events.filter((F.col("ts") < "2024-01-12") & ~late)
    second = events.filter((F.col("ts") >= "2024-01-12") & (F.col("ts") < "2024-01-20"))
    again = second.filter("event_id % 3 = 0").unionByName(first.filter(F.col("ts") >= "2024-01-11 23:00:00"))
    last = events.filter((F.col("ts") >= "2024-01-20") | late)
    table = DayTable(spark, f"{path}/ticks", "computingsite string, tick_time timestamp, walltime_loss decimal(28,2), nfailed_jobs bigint", "tick_time")

    def run() -> None:
        arriving = stw.stream_files(spark, f"{path}/source", spark.createDataFrame([], EVENTS).schema)
        jobs = arriving.selectExpr("event_id AS PANDAID", *TICK_COLUMNS)
        ticks = stw.closed_failure_windows(stw.failed_jobs(jobs), ["computingsite"], "PANDAID")
        table.follow(ticks, f"{path}/checkpoint").awaitTermination()

    fix.arrive([first, second.unionByName(again), last], f"{path}/source", "parquet", run)
    table.compact()
    final = table.read(datetime.date(2024, 1, 3), datetime.date(2024, 1, 31))
    return final.withColumn("walltime_loss", F.col("walltime_loss").cast("double"))


def stream_link_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    transfers = fix.transfers_of(_event_stream(spark, folder))
    path = scratch_path(spark, "links")
    stw.write_updates(stw.link_windows(transfers), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    windows = stw.read_updates(spark, f"{path}/out", ["src_site", "dst_site", "hour"])
    return stw.inefficient_windows(windows, 2, 20)


def stream_link_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of inefficient links per hour for both activities, from two streams each; the log arrives in two parts, so the
    second has late rows of the first's last hours."""
    source = scratch_path(spark, "transfers")
    events = fix.table(spark, folder, "events").select(*[c.split()[0] for c in EVENTS.split(", ")])
    late = F.col("event_id") % 2 == 1
    paths = {activity: scratch_path(spark, "link-issues") for activity in ("transfer", "deletion")}

    def run() -> None:
        for activity, path in paths.items():
            arriving = fix.transfers_of(stw.stream_files(spark, source, spark.createDataFrame([], EVENTS).schema))
            windows = {
                "links": stw.link_windows(arriving, lateness="60 days", state=activity),
                "reasons": stw.reason_windows(arriving, activity, lateness="60 days"),
            }
            for name, stream in windows.items():
                stw.write_updates(stream, f"{path}/{name}", f"{path}/checkpoint-{name}").awaitTermination()

    fix.arrive([events.filter(~late), events.filter(late)], source, "parquet", run)
    link = ["src_site", "dst_site", "hour"]
    issues = [
        stw.window_issues(stw.read_updates(spark, f"{path}/links", link), stw.read_updates(spark, f"{path}/reasons", [*link, "reason"]), activity, 1, 40)
        for activity, path in paths.items()
    ]
    return issues[0].unionByName(issues[1])


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The log arriving as files, loaded as a stream, and the issue table it leads to."""
    source = scratch_path(spark, "arriving")
    log = _log(spark, folder).withColumn("t__error_message", F.regexp_replace("t__error_message", "[0-9]+", "#"))
    log.select(F.struct(*LOG_COLUMNS).alias("data")).write.json(source)
    registry = files.host_sites(fix.site_registry(spark, folder))
    path = scratch_path(spark, "issues")
    stw.ingest_issues(spark, source, registry, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    issues = stw.registered_issues(spark, f"{path}/out", lambda b: b.cast("bigint"))
    return issues.select(*tra.ISSUE_KEY, "amount")


def batch_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of ``stream_ticks``, without gaps."""
    failed = job.with_lost_walltime(fix.jobs(spark, folder)).filter("JOBSTATUS = 'failed'")
    return iss.dense_ticks(failed, ["COMPUTINGSITE"]).withColumnRenamed("COMPUTINGSITE", "computingsite")


QUERIES = {
    f.__name__: f
    for f in (
        json_scan, json_dir_scan, day_paths, typed_fetch, fetch_formats, snapshot_load, registry_documents, registry_forms,
        load_days, stream_ticks, closed_ticks, stream_link_efficiency, stream_link_issues, stream_ingest, batch_ticks,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_HOST = r"regexp_extract({0}, '^(.*?://)?([\w.-]+).*', 2)"
_REGISTRY = f"""
registry AS (SELECT {_HOST.format('endpoint')} AS hostname, arg_min(site, pos) AS site FROM site_registry GROUP BY 1)"""


def _loaded(message: str, where: str = "") -> str:
    return (
        _REGISTRY
        + f""",
filled AS (
  SELECT {message} AS message, 'transfer-error' AS type,
    CASE WHEN coalesce(src_site_name, '') = '' THEN coalesce(s.site, '') ELSE src_site_name END AS src_site,
    CASE WHEN coalesce(dst_site_name, '') = '' THEN coalesce(d.site, '') ELSE dst_site_name END AS dst_site
  FROM messages LEFT JOIN registry s ON s.hostname = {_HOST.format('src_hostname')}
  LEFT JOIN registry d ON d.hostname = {_HOST.format('dst_hostname')} WHERE t_final_transfer_state_flag = 0 {where})
SELECT message, src_site, dst_site, type, count(*) AS amount FROM filled GROUP BY ALL"""
    )


SQL = {
    "json_scan": oracle("messages", "SELECT msg_id, t__error_message, epoch_us(ts) // 1000 AS timestamp_tr_comp FROM messages"),
    "json_dir_scan": oracle("messages", "SELECT msg_id, src_hostname, dst_site_name, t_final_transfer_state_flag FROM messages"),
    "day_paths": oracle(
        "messages",
        """SELECT msg_id, epoch_us(ts) // 1000 AS timestamp_tr_comp FROM messages
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'""",
    ),
    "typed_fetch": "SELECT o_orderkey, o_orderpriority FROM orders",
    "fetch_formats": "SELECT format, o_orderkey, o_orderpriority FROM orders, unnest(['JSON', 'parquet', 'ORC', 'CSV']) f(format)",
    "registry_forms": """SELECT 'protocols' AS form, 'SITE_' || (page_id // 2) AS site, url AS endpoint FROM pages
UNION ALL SELECT 'elements', 'SITE_' || (page_id // 4), url FROM pages""",
    "snapshot_load": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "registry_documents": oracle(
        "", rf"SELECT CAST(count(DISTINCT {_HOST.format('url')}) AS BIGINT) AS n_hosts FROM pages"
    ),
    "load_days": oracle(
        "messages site_registry",
        _loaded("t__error_message", "AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'"),
    ),
    "stream_ticks": """SELECT 'SITE_' || (user_id % 8) AS computingsite, time_bucket(INTERVAL 15 MINUTE, ts) AS tick_time,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS walltime_loss, count(*) AS nfailed_jobs
FROM events WHERE event_type = 'error' GROUP BY ALL""",
    "closed_ticks": """WITH failed AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS tick_time FROM events
  WHERE event_type = 'error' AND NOT (event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-05 00:00:00'))
SELECT 'SITE_' || (user_id % 8) AS computingsite, tick_time, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS walltime_loss,
  count(*) AS nfailed_jobs FROM failed
WHERE tick_time >= TIMESTAMP '2024-01-03 00:00:00' AND tick_time < TIMESTAMP '2024-02-01 00:00:00'
  AND tick_time + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM failed) GROUP BY ALL""",
    "stream_link_efficiency": oracle(
        "transfers",
        """SELECT src_site, dst_site, date_trunc('hour', ts) AS hour, CAST(sum(files_done) AS BIGINT) AS files_done,
  CAST(sum(files_total) AS BIGINT) AS files_total FROM transfers GROUP BY ALL
HAVING sum(files_total) > 2 AND 100.0 * sum(files_done) / sum(files_total) < 20""",
    ),
    "stream_link_issues": oracle(
        "transfers",
        """hours AS (SELECT *, date_trunc('hour', ts) AS hour FROM transfers),
links AS (SELECT src_site, dst_site, hour, state FROM hours GROUP BY ALL
  HAVING sum(files_total) > 1 AND 100.0 * sum(files_done) / sum(files_total) < 40),
counts AS (SELECT src_site, dst_site, hour, event_type, reason, count(*) AS amount FROM hours
  WHERE reason IS NOT NULL AND event_type LIKE '%-failed' GROUP BY ALL),
first_reason AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY src_site, dst_site, hour, event_type ORDER BY amount DESC, reason) = 1)
SELECT l.hour, reason AS message, amount, l.dst_site, l.src_site, l.state || '-failure' AS type FROM links l
JOIN first_reason r ON r.src_site = l.src_site AND r.dst_site = l.dst_site AND r.hour = l.hour AND r.event_type = l.state || '-failed'""",
    ),
    "stream_ingest": oracle("messages site_registry", _loaded("regexp_replace(t__error_message, '[0-9]+', '#', 'g')")),
    "batch_ticks": oracle(
        "jobs",
        """failed AS (SELECT computingsite, endtime, CASE WHEN starttime IS NULL THEN 0.0 ELSE
    (epoch_us(endtime) - epoch_us(starttime)) / 1e6 * CASE WHEN actualcorecount > 0 THEN actualcorecount ELSE 1 END END AS lost
  FROM jobs WHERE jobstatus = 'failed'),
tick AS (SELECT computingsite, time_bucket(INTERVAL 15 MINUTE, endtime) AS tick_time, CAST(sum(lost) AS DOUBLE) AS walltime_loss,
  count(*) AS nfailed_jobs FROM failed GROUP BY ALL),
span AS (SELECT computingsite, min(tick_time) AS a, max(tick_time) AS b FROM tick GROUP BY ALL),
grid AS (SELECT computingsite, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS tick_time FROM span)
SELECT g.computingsite, g.tick_time, coalesce(walltime_loss, 0.0) AS walltime_loss, coalesce(nfailed_jobs, 0) AS nfailed_jobs
FROM grid g LEFT JOIN tick t ON t.computingsite = g.computingsite AND t.tick_time = g.tick_time""",
    ),
}
