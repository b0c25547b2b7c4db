"""Queries over transfer issues and links."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import values
from faultscope.operators import search
from faultscope.operators import similarity as sml
from faultscope.operators import transfers as tra
from faultscope.plans import issue_registration as registration
from faultscope.plans import transfer_loading as plan
from faultscope.session import cut_lineage, scratch_path
from faultscope.sources import files
from faultscope.streaming import registration as sreg
from workload import fixtures as fix
from workload.fixtures import oracle

PARTS = ["HOST 10.0.7.1", "process 12 /DATA", "click 500", "r1", "no such part"]
NOW = datetime.datetime(2024, 2, 1)


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return files.host_sites(fix.site_registry(spark, folder))


def _as_of(transfers: DataFrame):
    return transfers.agg(F.max("ts")).scalar()


def failed_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return tra.failed_transfers(fix.messages(spark, folder)).select("msg_id", "tr_error_category")


def transfer_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Messages without their numbers, so that errors repeat."""
    log = fix.messages(spark, folder).withColumn(
        "t__error_message", F.regexp_replace("t__error_message", "[0-9]+", "#")
    )
    return tra.transfer_error_counts(log)


def site_fallback(spark: SparkSession, folder: str) -> DataFrame:
    issues = tra.fill_sites(tra.transfer_error_counts(fix.messages(spark, folder)), _registry(spark, folder))
    return issues.groupBy("src_site", "dst_site").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def log_issues(spark: SparkSession, folder: str) -> DataFrame:
    return plan.log_issues(fix.messages(spark, folder), _registry(spark, folder))


def link_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    return tra.inefficient(tra.link_efficiency(fix.transfers(spark, folder)), 200, 21)


def link_efficiency_window(spark: SparkSession, folder: str) -> DataFrame:
    transfers = fix.transfers(spark, folder)
    return tra.link_efficiency(transfers, _as_of(transfers), 24)


def top_reason(spark: SparkSession, folder: str) -> DataFrame:
    return tra.top_reasons(fix.transfers(spark, folder), size=2)


def link_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Links that failed lately, for both activities."""
    transfers = fix.transfers(spark, folder)
    transferred, deleted = (
        plan.inefficiency_issues(transfers, _as_of(transfers), 24 * 7, activity, min_files=20, max_percent=25)
        for activity in ("transfer", "deletion")
    )
    return transferred.unionByName(deleted)


def register_links(spark: SparkSession, folder: str) -> DataFrame:
    """The issue table after the links of both activities that failed lately are registered, and each category's amount.

    The table knew one link's issue before, with another amount, and the category of one reason.
    """
    transfers = fix.transfers(spark, folder)
    before = [("reason view", "S1", "D1", "transfer-failure", 7, datetime.datetime(2024, 1, 1), "reason view")]
    stored = spark.createDataFrame(before, registration.ISSUE_SCHEMA)
    categories = spark.createDataFrame([(4, "reason view", 7)], registration.CATEGORY_SCHEMA)
    limits = {"min_files": 20, "max_percent": 25}
    table, grown = plan.register_links(stored, categories, transfers, _as_of(transfers), F.lit(NOW), 24 * 7, **limits)
    sums = grown.select(F.col("regex").alias("category"), F.col("amount").alias("category_amount"))
    return table.join(sums, "category").select(*tra.ISSUE_KEY, "amount", "last_modified", "category", "category_amount")


def _by_day(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored issues from the first half of the month, incoming ones from the second."""
    log = fix.messages(spark, folder).withColumn(
        "t__error_message", F.regexp_replace("t__error_message", "[0-9]+", "#")
    )
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    stored = tra.sum_by_key(tra.transfer_error_counts(log.filter(first))).withColumn(
        "last_modified", F.lit("2024-01-16").cast("timestamp")
    )
    return stored, tra.transfer_error_counts(log.filter(~first))


def upsert_issues(spark: SparkSession, folder: str) -> DataFrame:
    return tra.upsert_issues(*_by_day(spark, folder), F.lit(NOW))


def category_amounts(spark: SparkSession, folder: str) -> DataFrame:
    stored, incoming = _by_day(spark, folder)
    categories = stored.groupBy(F.col("message").alias("category")).agg(
        F.sum("amount").alias("amount"), F.max("last_modified").alias("last_modified")
    )
    return tra.add_category_amounts(categories, incoming.withColumnRenamed("message", "category"), F.lit(NOW))


def _stored_issues(spark: SparkSession, folder: str) -> DataFrame:
    return fix.messages(spark, folder).select(
        F.col("msg_id").alias("id"),
        F.col("t__error_message").alias("message"),
        (F.col("msg_id") % 7).alias("category"),
        F.col("src_site_name").alias("src_site"),
        F.col("dst_site_name").alias("dst_site"),
        F.col("ts").alias("last_modified"),
    )


def search_issues(spark: SparkSession, folder: str) -> DataFrame:
    issues = _stored_issues(spark, folder)
    found = tra.search_issues(issues, message="transfer ERROR", categories="1,2,5", order_by="-last_modified", page=2)
    return found.select("id", "category", "last_modified")


def _index(spark: SparkSession, folder: str) -> search.IssueIndex:
    index = search.IssueIndex(spark, scratch_path(spark, "issue-index"), buckets=16)
    index.build(_stored_issues(spark, folder))
    return index


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages 1, 2 and 6 of a search through the index, each from its first key on, and the one that follows page 2."""
    order = "-last_modified"
    found = _index(spark, folder).search(message="transfer ERROR", categories="1,2,5")
    bounds = cut_lineage(search.page_bounds(found, order))
    pages = {number: search.page(found, bounds, number, order) for number in (1, 2, 6)}
    last = pages[2].orderBy("last_modified", F.desc("id")).first()
    pages[3] = search.next_page(found, last["last_modified"], last["id"], order) if last else found.limit(0)
    rows = [page.select(F.lit(number).alias("page"), "id", "category", "last_modified") for number, page in pages.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def search_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Issues whose message contains each of some parts, by the index: common, rare and short ones, and one that none has."""
    index = _index(spark, folder)
    rows = [index.search(message=part).select(F.lit(part).alias("part"), "id") for part in PARTS]
    return functools.reduce(DataFrame.unionByName, rows)


def parse_date(spark: SparkSession, folder: str) -> DataFrame:
    events = fix.table(spark, folder, "events")
    texts = events.select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "dd.MM.yyyy"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.date_format("ts", "MM-yyyy"))
        .alias("text"),
    )
    return texts.select("event_id", "text", values.parse_date(F.col("text")).alias("parsed"))


def similar_category(spark: SparkSession, folder: str) -> DataFrame:
    """Error texts against one stored text per worker's user, by Levenshtein similarity."""
    jobs = fix.jobs(spark, folder).filter(F.col("PILOTERRORDIAG").isNotNull())
    categories = jobs.groupBy(F.col("JEDITASKID").alias("id")).agg(F.min("PILOTERRORDIAG").alias("regex"))
    best = sml.best_category(
        jobs, categories, "PILOTERRORDIAG", "PANDAID", threshold=0.95, measure="levenshtein"
    )
    return best.select(
        F.col("PILOTERRORDIAG").alias("message"), "category", F.round("similarity", 6).alias("similarity")
    )


def categorise_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Categories founded by the failed transfers of the whole log, in the order of arrival."""
    issues = tra.failed_transfers(fix.messages(spark, folder)).select(
        F.col("msg_id").alias("id"), F.col("t__error_message").alias("message"), F.lit(1).alias("amount")
    )
    _, categories = sml.categorise_issues(issues)
    return categories


def _templated(spark: SparkSession, folder: str) -> DataFrame:
    return fix.messages(spark, folder).withColumn(
        "t__error_message", F.regexp_replace("t__error_message", "(process|host 10.0.|/data/f) ?[0-9]+", "$1#")
    )


def register_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of both halves of the month registered one after the other into stored tables: the
    issues per category, and the category's amount."""
    path = scratch_path(spark, "registration")
    log = _templated(spark, folder)
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    stored = spark.createDataFrame([], registration.ISSUE_SCHEMA)
    categories = spark.createDataFrame([], registration.CATEGORY_SCHEMA)
    for run, half in enumerate((first, ~first)):
        arrival = log.filter(half).groupBy(F.col("t__error_message").alias("message")).agg(F.min("msg_id").alias("id"))
        incoming = tra.sum_by_key(tra.transfer_error_counts(log.filter(half))).join(arrival, "message")
        incoming = incoming.withColumn("id", F.col("id") + run * 1_000_000_000)
        table, grown = registration.register_issues(stored, categories, incoming, F.lit(NOW))
        table.write.parquet(f"{path}/issues-{run}")
        grown.write.parquet(f"{path}/categories-{run}")
        stored, categories = spark.read.parquet(f"{path}/issues-{run}"), spark.read.parquet(f"{path}/categories-{run}")
    issues = stored.groupBy(F.col("category").alias("regex")).agg(F.count("*").alias("n_issues"))
    return categories.join(issues, "regex", "left").select("regex", "amount", "n_issues")


def stream_register(spark: SparkSession, folder: str, edges: tuple[str, ...] = ("2024-01-16",)) -> DataFrame:
    """The log arriving in parts of the month, registered part by part against the stored index: as ``register_issues``."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "registered")
    log = _templated(spark, folder)
    columns = F.struct(*[f.name for f in files.TRANSFER_FIELDS if f.name != "vo"]).alias("data")
    bounds = [None, *[F.lit(e).cast("timestamp") for e in edges], None]
    parts = []
    for low, high in zip(bounds, bounds[1:]):
        part = log if low is None else log.filter(F.col("ts") >= low)
        part = part if high is None else part.filter(F.col("ts") < high)
        parts.append(part.withColumn("timestamp_tr_comp", F.unix_millis("ts")).select(columns))
    issues_of = lambda rows: tra.sum_by_key(tra.transfer_error_counts(rows))

    def run() -> None:
        sreg.register_stream(
            spark, source, path, f"{path}/checkpoint", issues_of, "msg_id", now=lambda batch: F.lit(NOW)
        ).awaitTermination()

    fix.arrive(parts, source, "json", run)
    stored, categories = sreg.registered(spark, path)
    issues = stored.groupBy(F.col("category").alias("regex")).agg(F.count("*").alias("n_issues"))
    return categories.join(issues, "regex", "left").select("regex", "amount", "n_issues")


def best_category(spark: SparkSession, folder: str) -> DataFrame:
    """Failed transfers against the first message stored about each page, by matching blocks."""
    log = fix.messages(spark, folder)
    categories = log.groupBy("src_hostname").agg(
        F.min("msg_id").alias("id"), F.min_by("t__error_message", "msg_id").alias("regex")
    )
    failed = tra.failed_transfers(log)
    best = sml.best_category(failed, categories, "t__error_message", "msg_id")
    return best.withColumnRenamed("t__error_message", "message")


QUERIES = {
    f.__name__: f
    for f in (
        failed_transfers, transfer_errors, site_fallback, log_issues, link_efficiency,
        link_efficiency_window, top_reason, link_issues, register_links, upsert_issues, category_amounts,
        search_issues, search_pages, search_parts, parse_date, similar_category, best_category, categorise_issues, register_issues,
        stream_register,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_HOST = r"regexp_extract({0}, '^(.*?://)?([\w.-]+).*', 2)"
_MASKED = "regexp_replace(t__error_message, '[0-9]+', '#', 'g')"
_REGISTRY = f"""
registry AS (SELECT {_HOST.format('endpoint')} AS hostname, arg_min(site, pos) AS site FROM site_registry GROUP BY 1)"""
_FILLED = (
    _REGISTRY
    + f""",
grouped AS (
  SELECT t__error_message AS message, dst_site_name AS dst, src_site_name AS src, src_hostname, dst_hostname, count(*) AS amount
  FROM messages WHERE t_final_transfer_state_flag = 0 GROUP BY ALL),
filled AS (
  SELECT message, amount, CASE WHEN coalesce(src, '') = '' THEN coalesce(s.site, '') ELSE src END AS src_site,
    CASE WHEN coalesce(dst, '') = '' THEN coalesce(d.site, '') ELSE dst END AS dst_site, 'transfer-error' AS type
  FROM grouped LEFT JOIN registry s ON s.hostname = {_HOST.format('src_hostname')}
  LEFT JOIN registry d ON d.hostname = {_HOST.format('dst_hostname')})"""
)
_HALVES = f"""
masked AS (
  SELECT {_MASKED} AS message, src_site_name AS src_site, dst_site_name AS dst_site, 'transfer-error' AS type, ts
  FROM messages WHERE t_final_transfer_state_flag = 0),
stored AS (SELECT message, src_site, dst_site, type, count(*) AS amount FROM masked WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL),
incoming AS (SELECT message, src_site, dst_site, type, count(*) AS amount FROM masked WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY ALL)"""
_T1, _T2 = "TIMESTAMP '2024-01-16 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'"

SQL = {
    "failed_transfers": oracle(
        "messages", "SELECT msg_id, tr_error_category FROM messages WHERE t_final_transfer_state_flag = 0"
    ),
    "transfer_errors": oracle(
        "messages",
        f"""SELECT {_MASKED} AS message, dst_site_name AS dst_site, src_site_name AS src_site, src_hostname, dst_hostname,
  count(*) AS amount, 'transfer-error' AS type FROM messages WHERE t_final_transfer_state_flag = 0 GROUP BY ALL""",
    ),
    "site_fallback": oracle(
        "messages site_registry",
        _FILLED + " SELECT src_site, dst_site, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM filled GROUP BY ALL",
    ),
    "log_issues": oracle(
        "messages site_registry",
        _FILLED + " SELECT message, src_site, dst_site, type, CAST(sum(amount) AS BIGINT) AS amount FROM filled GROUP BY ALL",
    ),
    "link_efficiency": oracle(
        "transfers",
        """SELECT src_site, dst_site, CAST(sum(files_done) AS BIGINT) AS files_done, CAST(sum(files_total) AS BIGINT) AS files_total
FROM transfers GROUP BY ALL HAVING sum(files_total) > 200 AND 100.0 * sum(files_done) / sum(files_total) < 21""",
    ),
    "link_efficiency_window": oracle(
        "transfers",
        """SELECT src_site, dst_site, CAST(sum(files_done) AS BIGINT) AS files_done, CAST(sum(files_total) AS BIGINT) AS files_total
FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 24 HOUR GROUP BY ALL""",
    ),
    "top_reason": oracle(
        "transfers",
        """counts AS (SELECT src_site, dst_site, reason, count(*) AS amount FROM transfers WHERE reason IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY src_site, dst_site ORDER BY amount DESC, reason) AS INTEGER) AS rank
FROM counts QUALIFY rank <= 2""",
    ),
    "link_issues": oracle(
        "transfers",
        """recent AS (SELECT * FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 7 DAY),
links AS (SELECT src_site, dst_site, state FROM recent GROUP BY ALL
  HAVING sum(files_total) > 20 AND 100.0 * sum(files_done) / sum(files_total) < 25),
counts AS (SELECT src_site, dst_site, event_type, reason, count(*) AS amount FROM recent
  WHERE reason IS NOT NULL AND event_type LIKE '%-failed' GROUP BY ALL),
first_reason AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY src_site, dst_site, event_type ORDER BY amount DESC, reason) = 1)
SELECT reason AS message, amount, l.dst_site, l.src_site, l.state || '-failure' AS type FROM links l
JOIN first_reason r ON r.src_site = l.src_site AND r.dst_site = l.dst_site AND r.event_type = l.state || '-failed'""",
    ),
    "register_links": oracle(
        "transfers",
        """recent AS (SELECT * FROM transfers WHERE ts >= (SELECT max(ts) FROM transfers) - INTERVAL 7 DAY),
links AS (SELECT src_site, dst_site, state FROM recent GROUP BY ALL
  HAVING sum(files_total) > 20 AND 100.0 * sum(files_done) / sum(files_total) < 25),
counts AS (SELECT src_site, dst_site, event_type, reason, count(*) AS amount FROM recent
  WHERE reason IS NOT NULL AND event_type LIKE '%-failed' GROUP BY ALL),
first_reason AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY src_site, dst_site, event_type ORDER BY amount DESC, reason) = 1),
found AS (SELECT reason AS message, l.src_site, l.dst_site, l.state || '-failure' AS type, amount FROM links l
  JOIN first_reason r ON r.src_site = l.src_site AND r.dst_site = l.dst_site AND r.event_type = l.state || '-failed'),
stored AS (SELECT 'reason view' AS message, 'S1' AS src_site, 'D1' AS dst_site, 'transfer-failure' AS type, 7 AS amount),
issues AS (
  SELECT message, src_site, dst_site, type, coalesce(s.amount, f.amount) AS amount,
    CASE WHEN f.amount IS NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_modified, f.amount IS NOT NULL AS came
  FROM stored s FULL JOIN found f USING (message, src_site, dst_site, type)),
sums AS (SELECT message, sum(amount) AS total FROM (
  SELECT message, amount FROM issues WHERE came UNION ALL SELECT message, amount FROM stored) GROUP BY message)
SELECT message, src_site, dst_site, type, amount, last_modified, message AS category, CAST(total AS BIGINT) AS category_amount
FROM issues JOIN sums USING (message)""",
    ),
    "upsert_issues": oracle(
        "messages",
        _HALVES
        + f""" SELECT coalesce(s.message, i.message) AS message, coalesce(s.src_site, i.src_site) AS src_site,
  coalesce(s.dst_site, i.dst_site) AS dst_site, coalesce(s.type, i.type) AS type, coalesce(s.amount, i.amount) AS amount,
  CASE WHEN i.message IS NULL THEN {_T1} ELSE {_T2} END AS last_modified
FROM stored s FULL JOIN incoming i ON s.message = i.message AND s.src_site = i.src_site AND s.dst_site = i.dst_site AND s.type = i.type""",
    ),
    "category_amounts": oracle(
        "messages",
        _HALVES
        + f""", both_halves AS (SELECT message, amount, {_T1} AS t FROM stored UNION ALL SELECT message, amount, {_T2} FROM incoming)
SELECT message AS category, CAST(sum(amount) AS BIGINT) AS amount, max(t) AS last_modified FROM both_halves GROUP BY message""",
    ),
    "search_issues": oracle(
        "messages",
        """SELECT msg_id AS id, msg_id % 7 AS category, ts AS last_modified FROM messages
WHERE t__error_message ILIKE '%transfer error%' AND msg_id % 7 IN (1, 2, 5) ORDER BY ts DESC, msg_id LIMIT 100 OFFSET 100""",
    ),
    "search_pages": oracle(
        "messages",
        """found AS (SELECT msg_id AS id, msg_id % 7 AS category, ts AS last_modified, row_number() OVER (ORDER BY ts DESC, msg_id) - 1 AS place
  FROM messages WHERE t__error_message ILIKE '%transfer error%' AND msg_id % 7 IN (1, 2, 5))
SELECT CAST(place // 100 + 1 AS INT) AS page, id, category, last_modified FROM found WHERE place // 100 + 1 IN (1, 2, 3, 6)""",
    ),
    "search_parts": oracle(
        "messages",
        f"""SELECT part, msg_id AS id FROM messages, unnest({PARTS}) p(part) WHERE contains(lower(t__error_message), lower(part))""",
    ),
    "parse_date": """
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d.%m.%Y')
  WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%m-%Y') END AS text FROM events)
SELECT event_id, text, try_strptime(text, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y']) AS parsed FROM t""",
    "similar_category": oracle(
        "jobs",
        """texts AS (SELECT DISTINCT piloterrordiag AS message FROM jobs WHERE piloterrordiag IS NOT NULL),
categories AS (SELECT min(jeditaskid) AS id, regex FROM (
  SELECT jeditaskid, min(piloterrordiag) AS regex FROM jobs WHERE piloterrordiag IS NOT NULL GROUP BY jeditaskid) GROUP BY regex),
scored AS (
  SELECT message, id, 1 - levenshtein(message, regex) / greatest(length(message), length(regex)) AS similarity
  FROM texts CROSS JOIN categories)
SELECT message, first(id ORDER BY similarity DESC, id) AS category, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity > 0.95 GROUP BY message""",
    ),
}
