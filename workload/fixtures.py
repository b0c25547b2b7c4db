"""Inputs of the queries, derived from the given tables.

Every view exists twice: as a DataFrame here, and as a common table expression that the SQL
statements put in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.sources.files import spread

TABLE_TIMES = {"events": "ts"}
# The tables that queries do costly work on, row by row; here they are single row groups.
SPREAD = {"events", "documents"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with its times as time stamps in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in SPREAD:
        df = spread(df)
    if name in TABLE_TIMES:
        time = TABLE_TIMES[name]
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df


def arrive(parts: list[DataFrame], source: str, source_format: str, run) -> None:
    """Parts of a table that arrive one after the other, each in as many files as it has tasks; ``run`` streams all files that are
    there, so a part is one batch. The batch without rows, which moves the watermark on, follows the last part only."""
    spark, setting = parts[0].sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    given = spark.conf.get(setting)
    try:
        for k, part in enumerate(parts):
            part.write.mode("append").format(source_format).save(source)
            spark.conf.set(setting, given if k == len(parts) - 1 else "false")
            run()
    finally:
        spark.conf.set(setting, given)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Transfer log: one message per event, about the page its number falls on."""
    pages = table(spark, folder, "pages")
    events = table(spark, folder, "events").withColumn(
        "page", F.col("event_id") % pages.agg(F.count("*")).scalar()
    )
    return events.join(
        pages.select("page_id", "url"), F.col("page") == F.col("page_id")
    ).selectExpr(
        "event_id AS msg_id",
        "concat('TRANSFER ', upper(event_type), ' 500-500-System error: copy ', url,"
        " ' failed, message <', user_id, ':7> process ', event_id, ' /data/f', event_id % 5,"
        " '.root host 10.0.', user_id, '.1') AS t__error_message",
        "url AS src_hostname",
        "concat('srm://h', user_id % 10, '.example.org:8443/x') AS dst_hostname",
        "CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('S', user_id % 5) END AS src_site_name",
        "CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('D', user_id % 3) END AS dst_site_name",
        "event_type AS tr_error_category",
        "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS t_final_transfer_state_flag",
        "ts",
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter("event_id % 11 <> 0")
        .selectExpr("event_id AS msg_id", "CAST(event_id % 8 AS INT) AS prediction")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS PANDAID",
        "user_id AS JEDITASKID",
        "ts AS ENDTIME",
        "CASE WHEN event_id % 50 <> 0 THEN ts - INTERVAL 1 HOUR END AS STARTTIME",
        "CAST(user_id % 5 AS INT) AS ACTUALCORECOUNT",
        "CASE WHEN event_type = 'error' OR (user_id % 8 = 3 AND event_type = 'click')"
        " THEN 'failed' ELSE 'finished' END AS JOBSTATUS",
        "concat('SITE_', user_id % 8) AS COMPUTINGSITE",
        "CASE WHEN user_id % 9 <> 0 THEN concat('SE_', user_id % 5) END AS DESTINATIONSE",
        "CASE WHEN event_type = 'error' THEN concat('pilot lost heartbeat on worker', event_id,"
        " ' code ', user_id % 3) END AS PILOTERRORDIAG",
        "CASE WHEN event_type = 'error' THEN CAST(1000 + user_id % 3 AS INT) ELSE 0 END"
        " AS PILOTERRORCODE",
        "CASE WHEN event_type = 'click' AND user_id % 8 = 3 THEN 'stage-out failed' END"
        " AS DDMERRORDIAG",
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .selectExpr(
            "user_id AS JEDITASKID",
            "CASE WHEN user_id % 3 = 0 THEN concat('HPC_', user_id % 4) END AS SITE",
        )
        .distinct()
    )


def site_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The sites of the pages' hosts, and of those destination hosts whose number is below six."""
    sources = table(spark, folder, "pages").selectExpr(
        "page_id AS pos", "url AS endpoint", "concat('SITE_', page_id % 10) AS site"
    )
    hosts = table(spark, folder, "events").selectExpr("user_id % 10 AS host").filter("host < 6").distinct()
    destinations = hosts.selectExpr(
        "1000000000 + host AS pos",
        "concat('srm://h', host, '.example.org:8443/x') AS endpoint",
        "concat('STORE_', host % 4) AS site",
    )
    return sources.unionByName(destinations)


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").transform(transfers_of)


def transfers_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "ts",
        "concat('S', user_id % 5) AS src_site",
        "concat('D', event_id % 3) AS dst_site",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS files_done",
        "1 AS files_total",
        "CASE WHEN event_type <> 'purchase' THEN concat('reason ', event_type) END AS reason",
        "CASE WHEN event_id % 5 < 2 THEN 'deletion' ELSE 'transfer' END AS state",
        "concat(CASE WHEN event_id % 5 < 2 THEN 'deletion' ELSE 'transfer' END,"
        " CASE WHEN event_type IN ('purchase', 'view') THEN '-done' ELSE '-failed' END) AS event_type",
    )


def issue_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly failures of eight sites; the issues of a day report its ticks and, one higher,
    those of the day before."""
    return (
        table(spark, folder, "events")
        .filter("event_type = 'error'")
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .selectExpr(
            "(day(ts) + k) * 100 + user_id % 8 AS issue_id",
            "date_trunc('hour', ts) AS tick_time",
            "k",
            "CAST(value AS DECIMAL(18,2)) AS value",
        )
        .groupBy("issue_id", "tick_time", "k")
        .agg(
            F.sum("value").cast("decimal(18,2)").alias("walltime_loss"),
            (F.count("*") + F.col("k")).alias("nfailed_jobs"),
        )
        .drop("k")
    )


def issues(spark: SparkSession, folder: str) -> DataFrame:
    return (
        issue_ticks(spark, folder)
        .groupBy("issue_id")
        .agg(
            F.min("tick_time").alias("observation_started"),
            F.max("tick_time").alias("observation_finished"),
        )
        .selectExpr(
            "issue_id",
            "observation_started",
            "observation_finished",
            "CAST(issue_id % 100 % 3 AS INT) AS payload_type",
            "concat('msg ', issue_id) AS err_messages",
        )
    )


def issue_meta(spark: SparkSession, folder: str) -> DataFrame:
    """One or two features per issue."""
    found = issues(spark, folder)
    return found.selectExpr(
        "issue_id",
        """inline(CASE WHEN issue_id % 100 < 4 THEN array(
             struct('COMPUTINGSITE' AS key, concat('SITE_', issue_id % 100) AS value),
             struct('DESTINATIONSE' AS key, concat('SE_', issue_id % 100 % 2) AS value))
           ELSE array(struct('COMPUTINGSITE' AS key, concat('SITE_', issue_id % 100) AS value))
           END)""",
    )


VIEWS = {
    "messages": """
SELECT e.event_id AS msg_id,
  concat('TRANSFER ', upper(e.event_type), ' 500-500-System error: copy ', p.url, ' failed, message <', CAST(e.user_id AS STRING), ':7> process ', CAST(e.event_id AS STRING), ' /data/f', CAST(e.event_id % 5 AS STRING), '.root host 10.0.', CAST(e.user_id AS STRING), '.1') AS t__error_message,
  p.url AS src_hostname, concat('srm://h', CAST(e.user_id % 10 AS STRING), '.example.org:8443/x') AS dst_hostname,
  CASE WHEN e.user_id % 4 = 0 THEN '' ELSE concat('S', CAST(e.user_id % 5 AS STRING)) END AS src_site_name,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE concat('D', CAST(e.user_id % 3 AS STRING)) END AS dst_site_name, e.event_type AS tr_error_category,
  CASE WHEN e.event_type = 'error' THEN 0 ELSE 1 END AS t_final_transfer_state_flag, e.ts AS ts
FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) k JOIN pages p ON p.page_id = e.event_id % k.n""",
    "predictions": """
SELECT event_id AS msg_id, CAST(event_id % 8 AS INT) AS prediction FROM events WHERE event_id % 11 <> 0""",
    "jobs": """
SELECT event_id AS pandaid, user_id AS jeditaskid, ts AS endtime,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts - INTERVAL 1 HOUR END AS starttime,
  CAST(user_id % 5 AS INT) AS actualcorecount,
  CASE WHEN event_type = 'error' OR (user_id % 8 = 3 AND event_type = 'click') THEN 'failed' ELSE 'finished' END AS jobstatus,
  concat('SITE_', CAST(user_id % 8 AS STRING)) AS computingsite,
  CASE WHEN user_id % 9 = 0 THEN NULL ELSE concat('SE_', CAST(user_id % 5 AS STRING)) END AS destinationse,
  CASE WHEN event_type = 'error' THEN concat('pilot lost heartbeat on worker', CAST(event_id AS STRING), ' code ', CAST(user_id % 3 AS STRING)) END AS piloterrordiag,
  CASE WHEN event_type = 'error' THEN CAST(1000 + user_id % 3 AS INT) ELSE 0 END AS piloterrorcode,
  CASE WHEN event_type = 'click' AND user_id % 8 = 3 THEN 'stage-out failed' END AS ddmerrordiag
FROM events""",
    "tasks": """
SELECT DISTINCT user_id AS jeditaskid, CASE WHEN user_id % 3 = 0 THEN concat('HPC_', CAST(user_id % 4 AS STRING)) END AS site FROM events""",
    "site_registry": """
SELECT page_id AS pos, url AS endpoint, concat('SITE_', CAST(page_id % 10 AS STRING)) AS site FROM pages
UNION ALL SELECT DISTINCT 1000000000 + user_id % 10, concat('srm://h', CAST(user_id % 10 AS STRING), '.example.org:8443/x'),
  concat('STORE_', CAST(user_id % 10 % 4 AS STRING)) FROM events WHERE user_id % 10 < 6""",
    "transfers": """
SELECT ts, concat('S', CAST(user_id % 5 AS STRING)) AS src_site, concat('D', CAST(event_id % 3 AS STRING)) AS dst_site,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS files_done, 1 AS files_total,
  CASE WHEN event_type <> 'purchase' THEN concat('reason ', event_type) END AS reason,
  CASE WHEN event_id % 5 < 2 THEN 'deletion' ELSE 'transfer' END AS state,
  concat(CASE WHEN event_id % 5 < 2 THEN 'deletion' ELSE 'transfer' END,
    CASE WHEN event_type IN ('purchase', 'view') THEN '-done' ELSE '-failed' END) AS event_type FROM events""",
    "issue_ticks": """
SELECT (day(ts) + k) * 100 + user_id % 8 AS issue_id, date_trunc('hour', ts) AS tick_time,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS walltime_loss, count(*) + k AS nfailed_jobs
FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x WHERE event_type = 'error'
GROUP BY (day(ts) + k) * 100 + user_id % 8, date_trunc('hour', ts), k""",
    "issues": """
SELECT issue_id, min(tick_time) AS observation_started, max(tick_time) AS observation_finished,
  CAST(issue_id % 100 % 3 AS INT) AS payload_type, concat('msg ', CAST(issue_id AS STRING)) AS err_messages FROM issue_ticks GROUP BY issue_id""",
    "issue_meta": """
SELECT issue_id, 'COMPUTINGSITE' AS key, concat('SITE_', CAST(issue_id % 100 AS STRING)) AS value FROM issues
UNION ALL SELECT issue_id, 'DESTINATIONSE', concat('SE_', CAST(issue_id % 100 % 2 AS STRING)) FROM issues WHERE issue_id % 100 < 4""",
}
NEEDS = {"issues": ["issue_ticks"], "issue_meta": ["issue_ticks", "issues"]}


def oracle(views: str, body: str) -> str:
    """SQL statement with the named views in front. ``body`` is a SELECT, or further table
    expressions followed by one."""
    names: list[str] = []
    for view in views.split():
        names += [n for n in [*NEEDS.get(view, []), view] if n not in names]
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
    return "WITH RECURSIVE " + ",\n".join([*parts, body])
