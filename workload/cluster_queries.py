"""Queries over clustered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import text, values
from faultscope.operators import messages as msg
from faultscope.operators import patterns as pat
from faultscope.plans.cluster_summary import cluster_summary as summarise
from faultscope.sources import files
from workload import fixtures as fix
from workload.fixtures import oracle
from workload.text_queries import ABSTRACT_CTE, token_ctes


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and patterns of the messages that have a cluster."""
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    return msg.abstract_messages(tokens).join(fix.predictions(spark, folder), "msg_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = fix.table(spark, folder, "documents")
    return documents.withColumn("tokens", text.words(F.lower("text")))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return files.host_sites(fix.site_registry(spark, folder))


def _hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The message table with bare host names, as the transfer log has them."""
    hosts = {c: text.hostname(F.col(c)) for c in ("src_hostname", "dst_hostname")}
    return fix.messages(spark, folder).withColumns(hosts)


def cluster_stats(spark: SparkSession, folder: str) -> DataFrame:
    return pat.cluster_stats(_clustered(spark, folder))


def pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = pat.pattern_counts(_clustered(spark, folder), "prediction", "abstract_message", "n")
    return counts.withColumn("abstract_message", F.array_join("abstract_message", "|"))


def top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    top = pat.top_patterns(
        _clustered(spark, folder), "prediction", "abstract_message", "n_patterns", 3, detokenize=True
    )
    return top.withColumn("msg_perc", F.round("msg_perc", 6))


def all_sources(spark: SparkSession, folder: str) -> DataFrame:
    data = fix.messages(spark, folder).join(fix.predictions(spark, folder), "msg_id")
    ranked = pat.top_patterns(data, "prediction", "src_hostname", "n_src")
    return ranked.withColumn("src_perc", F.round("src_perc", 6))


def document_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracted documents per source: whole texts, with exact copies as repeated patterns."""
    tokens = msg.tokenize_messages(fix.table(spark, folder, "documents"), "text", "doc_id")
    data = msg.abstract_messages(tokens).join(
        fix.table(spark, folder, "documents").select("doc_id", "source"), "doc_id"
    )
    top = pat.top_patterns(data, "source", "abstract_message", "n_patterns", 3, detokenize=True)
    return top.select("source", F.md5("pattern").alias("pattern_md5"), "n_patterns", F.round("msg_perc", 6).alias("msg_perc"), "rank_pattern")


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder)).drop("t__error_message")
    _, summary = summarise(
        tokens.join(fix.predictions(spark, folder), "msg_id", "left"),
        original=_hosts(spark, folder),
        registry=_registry(spark, folder),
        run_id="r1",
    )
    rounded = {c: F.round(c, 6) for c in ("msg_perc", "src_perc", "dst_perc")}
    return summary.withColumns(rounded)


def merge_predictions(spark: SparkSession, folder: str) -> DataFrame:
    merged = pat.merge_predictions(
        fix.messages(spark, folder), fix.predictions(spark, folder), out_cols=["msg_id", "prediction"]
    )
    return merged.select("msg_id", "src_hostname", "prediction").orderBy("msg_id")


def site_lookup(spark: SparkSession, folder: str) -> DataFrame:
    data = _hosts(spark, folder).select("msg_id", "src_hostname", "dst_hostname")
    return pat.hosts_to_sites(data, _registry(spark, folder), ["src_hostname", "dst_hostname"])


def site_registry(spark: SparkSession, folder: str) -> DataFrame:
    return _registry(spark, folder)


def cluster_token_freq(spark: SparkSession, folder: str) -> DataFrame:
    top = pat.cluster_token_frequency(_documents(spark, folder), "tokens", "source", 20)
    return top.select("source", "token", "n", "rank", F.round("weight", 6).alias("weight"))


def cluster_trend(spark: SparkSession, folder: str) -> DataFrame:
    data = fix.messages(spark, folder).join(fix.predictions(spark, folder), "msg_id")
    return pat.cluster_trend(data.withColumn("time_ms", F.unix_millis("ts")), "time_ms")


def minute_of(spark: SparkSession, folder: str) -> DataFrame:
    return fix.table(spark, folder, "events").select(
        "event_id", values.minute_of(F.unix_millis("ts")).alias("minute")
    )


QUERIES = {
    f.__name__: f
    for f in (
        cluster_stats, pattern_counts, top_patterns, all_sources, document_patterns, cluster_summary,
        merge_predictions, site_lookup, site_registry, cluster_token_freq, cluster_trend, minute_of,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_TOKENS = token_ctes("messages", "msg_id", "t__error_message") + "," + ABSTRACT_CTE
_CLUSTERED = _TOKENS + """,
clustered AS (SELECT a.*, p.prediction FROM abstracted a JOIN predictions p ON p.msg_id = a.msg_id)"""
_HOST = r"regexp_extract({0}, '^(.*?://)?([\w.-]+).*', 2)"
_REGISTRY = f"""
registry AS (SELECT {_HOST.format('endpoint')} AS hostname, arg_min(site, pos) AS site FROM site_registry GROUP BY 1)"""


def _ranked(name: str, source: str, cluster: str, value: str, n: str, perc: str) -> str:
    return f"""
{name} AS (SELECT {cluster}, {value} AS v, count(*) AS {n},
    round(count(*) / sum(count(*)) OVER (PARTITION BY {cluster}), 6) AS {perc},
    rank() OVER (PARTITION BY {cluster} ORDER BY count(*) DESC, {value}) AS rank_pattern
  FROM {source} GROUP BY {cluster}, {value})"""


SQL = {
    "cluster_stats": oracle(
        "messages predictions",
        _CLUSTERED
        + """ SELECT prediction, count(*) AS n_messages, count(DISTINCT stop_token_1) AS unique_strings,
  count(DISTINCT abstract_message) AS unique_patterns FROM clustered GROUP BY prediction""",
    ),
    "pattern_counts": oracle(
        "messages predictions",
        _CLUSTERED
        + """ SELECT prediction, array_to_string(abstract_message, '|') AS abstract_message, count(*) AS n
  FROM clustered GROUP BY prediction, abstract_message""",
    ),
    "top_patterns": oracle(
        "messages predictions",
        _CLUSTERED
        + ","
        + _ranked("ranked", "clustered", "prediction", "abstract_message", "n_patterns", "msg_perc")
        + """ SELECT prediction, array_to_string(v, ' ') AS pattern, n_patterns, msg_perc, rank_pattern
  FROM ranked WHERE rank_pattern <= 3""",
    ),
    "all_sources": oracle(
        "messages predictions",
        "data AS (SELECT m.*, p.prediction FROM messages m JOIN predictions p ON p.msg_id = m.msg_id),"
        + _ranked("ranked", "data", "prediction", "src_hostname", "n_src", "src_perc")
        + " SELECT prediction, v AS src_hostname, n_src, src_perc, rank_pattern FROM ranked",
    ),
    "document_patterns": oracle(
        "",
        token_ctes("documents", "doc_id", "text").strip()
        + ","
        + ABSTRACT_CTE
        + ", data AS (SELECT a.abstract_message, d.source FROM abstracted a JOIN documents d ON d.doc_id = a.doc_id),"
        + _ranked("ranked", "data", "source", "abstract_message", "n_patterns", "msg_perc")
        + """ SELECT source, md5(array_to_string(v, ' ')) AS pattern_md5, n_patterns, msg_perc, rank_pattern
  FROM ranked WHERE rank_pattern <= 3""",
    ),
    "cluster_summary": oracle(
        "messages predictions site_registry",
        _TOKENS
        + ","
        + _REGISTRY
        + f""",
data AS (
  SELECT p.prediction, a.stop_token_1, a.abstract_message, s.site AS src_hostname, d.site AS dst_hostname
  FROM messages m JOIN abstracted a ON a.msg_id = m.msg_id LEFT JOIN predictions p ON p.msg_id = m.msg_id
  LEFT JOIN registry s ON s.hostname = {_HOST.format('m.src_hostname')}
  LEFT JOIN registry d ON d.hostname = {_HOST.format('m.dst_hostname')}),
stats AS (
  SELECT prediction, count(*) AS n_messages, count(DISTINCT stop_token_1) AS unique_strings,
    count(DISTINCT abstract_message) AS unique_patterns FROM data GROUP BY prediction),"""
        + _ranked("messages_ranked", "data", "prediction", "abstract_message", "n_patterns", "msg_perc")
        + ","
        + _ranked("src_ranked", "data", "prediction", "src_hostname", "n_src", "src_perc").replace(
            "count(*) DESC, src_hostname", "count(*) DESC, src_hostname NULLS FIRST")
        + ","
        + _ranked("dst_ranked", "data", "prediction", "dst_hostname", "n_dst", "dst_perc").replace(
            "count(*) DESC, dst_hostname", "count(*) DESC, dst_hostname NULLS FIRST")
        + """,
msg_part AS (SELECT * FROM messages_ranked WHERE rank_pattern <= 3),
src_part AS (SELECT * FROM src_ranked WHERE rank_pattern <= 3),
dst_part AS (SELECT * FROM dst_ranked WHERE rank_pattern <= 3),
ranks AS (
  SELECT coalesce(a.prediction, b.prediction) AS prediction, coalesce(a.rank_pattern, b.rank_pattern) AS rank_pattern,
    array_to_string(a.v, ' ') AS pattern, n_patterns, msg_perc, b.v AS src_hostname, n_src, src_perc
  FROM msg_part a FULL JOIN src_part b ON a.prediction IS NOT DISTINCT FROM b.prediction AND a.rank_pattern = b.rank_pattern),
wide AS (
  SELECT coalesce(a.prediction, b.prediction) AS prediction, coalesce(a.rank_pattern, b.rank_pattern) AS rank_pattern,
    pattern, n_patterns, msg_perc, src_hostname, n_src, src_perc, b.v AS dst_hostname, n_dst, dst_perc
  FROM ranks a FULL JOIN dst_part b ON a.prediction IS NOT DISTINCT FROM b.prediction AND a.rank_pattern = b.rank_pattern),
summary AS (
  SELECT coalesce(s.prediction, w.prediction) AS prediction, n_messages, unique_strings, unique_patterns,
    w.* EXCLUDE (prediction) FROM stats s FULL JOIN wide w ON s.prediction IS NOT DISTINCT FROM w.prediction)
SELECT sha256('r1/' || coalesce(CAST(prediction AS VARCHAR), '')) AS "clust_UUID", *, 'pyspark_based' AS model_ref FROM summary""",
    ),
    "merge_predictions": oracle(
        "messages predictions",
        """SELECT m.msg_id, src_hostname, prediction FROM messages m FULL JOIN predictions p ON p.msg_id = m.msg_id""",
    ),
    "site_lookup": oracle(
        "messages site_registry",
        _REGISTRY
        + f""" SELECT msg_id, s.site AS src_hostname, d.site AS dst_hostname FROM messages m
  LEFT JOIN registry s ON s.hostname = {_HOST.format('m.src_hostname')}
  LEFT JOIN registry d ON d.hostname = {_HOST.format('m.dst_hostname')}""",
    ),
    "site_registry": oracle("site_registry", _REGISTRY + " SELECT hostname, site FROM registry"),
    "cluster_token_freq": r"""
WITH token AS (SELECT source, unnest(string_split_regex(lower(text), '\s+')) AS token FROM documents),
counts AS (SELECT source, token, count(*) AS n FROM token WHERE token <> '' GROUP BY source, token),
ranked AS (SELECT *, max(n) OVER (PARTITION BY source) AS top,
  row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM counts)
SELECT source, token, n, CAST(rank AS INTEGER) AS rank, round(n / top, 6) AS weight FROM ranked WHERE rank <= 20""",
    "cluster_trend": oracle(
        "messages predictions",
        """data AS (
  SELECT prediction, epoch_us(date_trunc('minute', ts)) AS t FROM messages m JOIN predictions p ON p.msg_id = m.msg_id),
spans AS (SELECT prediction, min(t) AS lo, max(t) - min(t) AS width FROM data GROUP BY prediction),
binned AS (
  SELECT d.prediction, CASE WHEN width = 0 THEN 1 ELSE greatest(1, ((t - lo) * 144 + width - 1) // width) END AS bin
  FROM data d JOIN spans s ON s.prediction = d.prediction),
grid AS (SELECT prediction, lo, width, unnest(generate_series(1, 144)) AS bin FROM spans)
SELECT g.prediction, CAST(g.bin AS INTEGER) AS bin, make_timestamp(lo + (g.bin * width) // 144) AS bin_end, count(b.bin) AS n_messages
FROM grid g LEFT JOIN binned b ON b.prediction = g.prediction AND b.bin = g.bin
GROUP BY g.prediction, g.bin, lo, width""",
    ),
    "minute_of": "SELECT event_id, date_trunc('minute', ts) AS minute FROM events",
}
