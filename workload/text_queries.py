"""Queries over messages, tokens and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.functions import text
from faultscope.functions.stopwords import ENGLISH
from faultscope.operators import messages as msg
from workload import fixtures as fix
from workload.fixtures import oracle


def _joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


def flatten_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = fix.messages(spark, folder).withColumn("timestamp_tr_comp", F.unix_millis("ts"))
    return msg.flatten_select(rows.select(F.struct("*").alias("data")))


def url_tokens(spark: SparkSession, folder: str) -> DataFrame:
    pages = fix.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        text.url_token(F.col("url")).alias("url_token"),
        text.url_token(F.col("url"), keep_bare_host=True).alias("url_token_host"),
        text.url_token(F.concat("url", F.lit(";a=b"))).alias("parameter_token"),
    )


def split_urls(spark: SparkSession, folder: str) -> DataFrame:
    return fix.messages(spark, folder).select(
        "msg_id", text.split_urls(F.col("t__error_message")).alias("corrected_message")
    )


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    names = ["tokens", "tokens_cleaned", "stop_token", "stop_token_1"]
    return tokens.select("msg_id", "corrected_message", *_joined(*names))


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = fix.table(spark, folder, "documents")
    tokens = msg.tokenize_messages(documents, "text", "doc_id")
    return tokens.select(
        "doc_id",
        F.size("tokens_cleaned").cast("bigint").alias("n_cleaned"),
        F.size("stop_token_1").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("stop_token_1", "|")).alias("tokens_md5"),
    )


def detokenize(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    return msg.detokenize_messages(tokens, "stop_token_1").select("msg_id", "message_string")


def token_class(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    token = F.col("token")
    return (
        tokens.select(F.explode("tokens_cleaned").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .select(
            "token",
            "n",
            text.is_url(token).alias("is_url"),
            text.is_ipv6(token).alias("is_ipv6"),
            text.is_address(token).alias("is_address"),
            text.is_file_path(token).alias("is_file_path"),
            text.replace_parameters(token).alias("kind"),
            text.replace_parameters(token, "XX").alias("general_kind"),
        )
    )


def replace_ids(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    cleaned = F.col("tokens_cleaned")
    return tokens.select(
        "msg_id",
        F.array_join(text.replace_ids(cleaned), "|").alias("tokens"),
        F.array_join(text.replace_ids(cleaned, strict_message_id=True), "|").alias("strict_tokens"),
    )


def abstract_message(spark: SparkSession, folder: str) -> DataFrame:
    tokens = msg.tokenize_messages(fix.messages(spark, folder))
    return msg.abstract_messages(tokens).select("msg_id", *_joined("abstract_message"))


def mask_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return fix.jobs(spark, folder).select(
        F.col("PANDAID").alias("pandaid"), text.mask_numbers(F.col("PILOTERRORDIAG")).alias("masked")
    )


def mask_rare_words(spark: SparkSession, folder: str) -> DataFrame:
    diag = ["DDMERRORDIAG", "PILOTERRORDIAG"]
    jobs = fix.jobs(spark, folder).select("PANDAID", *diag)
    masked = msg.mask_rare_words(jobs, diag, "PANDAID")
    return masked.select(*[F.col(c).alias(c.lower()) for c in masked.columns])


def mask_rare_document_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = fix.table(spark, folder, "documents").select("doc_id", "text")
    masked = msg.mask_rare_words(documents, ["text"], "doc_id")
    return masked.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def word_frequency(spark: SparkSession, folder: str) -> DataFrame:
    jobs = fix.jobs(spark, folder)
    return msg.word_frequency(jobs, ["DDMERRORDIAG", "PILOTERRORDIAG"])


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    documents = fix.table(spark, folder, "documents")
    tokens = documents.withColumn("tokens", text.words(F.lower("text")))
    return msg.vocabulary(tokens, "tokens")


def hostname(spark: SparkSession, folder: str) -> DataFrame:
    return fix.messages(spark, folder).select(
        "msg_id",
        text.hostname(F.col("src_hostname")).alias("src"),
        text.hostname(F.col("dst_hostname")).alias("dst"),
    )


def feature_names(spark: SparkSession, folder: str) -> DataFrame:
    jobs = fix.jobs(spark, folder).select(F.concat(F.lit("COMPUTINGSITE_"), "COMPUTINGSITE").alias("name"))
    return jobs.distinct().select("name", text.split_feature_name(F.col("name")).alias("s")).select("name", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        flatten_select, url_tokens, split_urls, tokenize, tokenize_documents, detokenize,
        token_class, replace_ids, abstract_message, mask_numbers, mask_rare_words,
        mask_rare_document_words, word_frequency, vocabulary, hostname, feature_names,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_SCHEMES = "'', 'ftp', 'hdl', 'prospero', 'http', 'https', 'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip', 'sips', 'mms', 'sftp', 'tel'"


def _url_ctes(source: str, keys: str, token: str) -> str:
    """Table expressions from ``source`` to ``url_parts`` with scheme, host and path of a token."""
    return rf"""
url_scheme AS (
  SELECT {keys}, {token} AS t, lower(regexp_extract({token}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
    regexp_replace({token}, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest FROM {source}),
url_path AS (
  SELECT {keys}, scheme, regexp_extract(rest, '^//([^/?#]*)', 1) AS host,
    regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS path FROM url_scheme),
url_parts AS (
  SELECT {keys}, scheme, host, CASE WHEN scheme IN ({_SCHEMES})
    THEN regexp_replace(path, '^((?:.*/)?[^/;]*);[^/]*$', '\1') ELSE path END AS path FROM url_path)"""


_URL_TEXT = """CASE WHEN scheme = '' THEN path
    WHEN host <> '' AND path <> '' THEN scheme || '://' || host || ' ' || path
    ELSE scheme || ':' || path END"""
_URL_TEXT_HOST = """CASE WHEN scheme = '' THEN path
    WHEN host <> '' AND path <> '' THEN scheme || '://' || host || ' ' || path
    WHEN host <> '' THEN scheme || '://' || host
    ELSE scheme || ':' || path END"""

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


def token_ctes(source: str, key: str, message: str) -> str:
    """Table expressions up to ``tokenized`` with all token columns."""
    return (
        rf"""
words AS (
  SELECT {key}, list_filter(string_split_regex({message}, '\s+'), lambda w: w <> '') AS w FROM {source}),
word AS (SELECT {key}, unnest(w) AS t0, generate_subscripts(w, 1) AS pos FROM words),"""
        + _url_ctes("word", f"{key}, pos", "t0")
        + rf""",
rejoined AS (
  SELECT {key}, string_agg({_URL_TEXT}, ' ' ORDER BY pos) AS joined FROM url_parts GROUP BY {key}),
corrected AS (
  SELECT s.{key}, coalesce(joined, '') AS corrected_message FROM {source} s LEFT JOIN rejoined r ON r.{key} = s.{key}),
lowered AS (SELECT *, string_split_regex(lower(corrected_message), '\s') AS tokens FROM corrected),
stripped AS (
  SELECT *, list_transform(list_filter(tokens, lambda t: t <> ''), lambda t: trim(t, ':;,.- ')) AS s FROM lowered),
cleaned AS (
  SELECT * EXCLUDE (s), flatten(list_transform(s, lambda t:
    CASE WHEN regexp_extract(t, '^(\+?\d+(?:_\d+)*)-', 1) = '' THEN [t]
    ELSE [regexp_extract(t, '^(\+?\d+(?:_\d+)*)-', 1),
          replace(t, regexp_extract(t, '^(\+?\d+(?:_\d+)*)-', 1) || '-', '')] END)) AS tokens_cleaned FROM stripped),
unstopped AS (
  SELECT *, list_filter(tokens_cleaned, lambda t: t NOT IN ({_STOP})) AS stop_token FROM cleaned),
tokenized AS (
  SELECT *, list_filter(stop_token, lambda t: t NOT IN ('', ':', '-', '+')) AS stop_token_1 FROM unstopped)"""
    )


_COLONS = "length(t) - length(replace(t, ':', ''))"
_POINTS = "length(t) - length(replace(t, '.', ''))"
_IS_URL = "contains(t, '://')"
_IS_IPV6 = f"({_COLONS} >= 3 AND NOT contains(t, '/'))"
_IS_ADDRESS = f"({_POINTS} >= 2 AND NOT contains(t, '/'))"
_IS_FILE = "(starts_with(t, '/') AND contains(substr(t, 2), '.') AND contains(substr(t, 2), '/'))"
_KIND = rf"""CASE WHEN {_IS_URL} THEN '\$URL' WHEN {_IS_IPV6} THEN '\$IPv6' WHEN {_IS_ADDRESS} THEN '\$ADDRESS'
  WHEN starts_with(t, 'path=') THEN '\$PATH' WHEN {_IS_FILE} THEN '\$FILE_PATH'
  WHEN starts_with(t, '[net=') THEN '\$NET_PARAM' WHEN starts_with(t, '(expected=') THEN '\$EXPECTED_SIZE'
  WHEN starts_with(t, 'actual=') THEN '\$ACTUAL_SIZE' WHEN starts_with(t, '(/cn=') THEN '\$EXPECTED_REMOTE_ENTITY'
  WHEN starts_with(t, '(/dc=') THEN '\$ACTUAL_REMOTE_ENTITY' ELSE t END"""
_GENERAL = f"CASE WHEN {_IS_URL} OR {_IS_IPV6} OR {_IS_ADDRESS} OR starts_with(t, 'path=') THEN 'XX' ELSE t END"


def _ids(tokens: str, strict: bool = False) -> str:
    kept = "[t]" if strict else rf"[t, '\$MESSAGE_ID']"
    previous = f"{tokens}[i - 1]"
    return rf"""flatten(list_transform({tokens}, lambda t, i:
    CASE WHEN i = 1 OR {previous} NOT IN ('transaction', 'process', 'message', 'relation', 'database', 'tuple') THEN [t]
    WHEN {previous} = 'message' AND NOT regexp_matches(t, '^<[0-9]+:[0-9]+>') THEN {kept}
    ELSE ['\$' || upper({previous}) || '_ID'] END))"""


ABSTRACT_CTE = f"""
kinds AS (SELECT *, list_transform(tokens_cleaned, lambda t: {_KIND}) AS k FROM tokenized),
abstracted AS (SELECT * EXCLUDE (k), {_ids("k")} AS abstract_message FROM kinds)"""


def mask_ctes(field: str, source: str = "jobs", key: str = "pandaid") -> str:
    """Table expressions ``<field>_masked`` (key, masked): the text with its rare words replaced."""
    return f"""
{field}_words AS (
  SELECT {key}, unnest(string_split({field}, ' ')) AS w, generate_subscripts(string_split({field}, ' '), 1) AS pos
  FROM {source} WHERE {field} IS NOT NULL AND {field} <> 'Not specified'),
{field}_counts AS (
  SELECT lower(w) AS lw, count(*) AS n FROM {field}_words WHERE w <> '' GROUP BY lower(w)),
{field}_masked AS (
  SELECT {key}, string_agg(CASE WHEN n < 3 AND length(w) > 3 THEN '**REPLACEMENT**' ELSE w END, ' ' ORDER BY pos) AS masked
  FROM {field}_words LEFT JOIN {field}_counts ON lw = w GROUP BY {key})"""


_MESSAGE_TOKENS = token_ctes("messages", "msg_id", "t__error_message")

SQL = {
    "flatten_select": oracle(
        "messages",
        "SELECT msg_id, t__error_message, src_hostname, dst_hostname, epoch_us(ts) // 1000 AS timestamp_tr_comp FROM messages",
    ),
    "url_tokens": oracle(
        "",
        "token AS (SELECT page_id, 1 AS v, url AS t0 FROM pages UNION ALL SELECT page_id, 2, url || ';a=b' FROM pages),"
        + _url_ctes("token", "page_id, v", "t0")
        + f"""
SELECT page_id, max({_URL_TEXT}) FILTER (v = 1) AS url_token, max({_URL_TEXT_HOST}) FILTER (v = 1) AS url_token_host,
  max({_URL_TEXT}) FILTER (v = 2) AS parameter_token FROM url_parts GROUP BY page_id""",
    ),
    "split_urls": oracle("messages", _MESSAGE_TOKENS + " SELECT msg_id, corrected_message FROM corrected"),
    "tokenize": oracle(
        "messages",
        _MESSAGE_TOKENS
        + """ SELECT msg_id, corrected_message, array_to_string(tokens, '|') AS tokens,
  array_to_string(tokens_cleaned, '|') AS tokens_cleaned, array_to_string(stop_token, '|') AS stop_token,
  array_to_string(stop_token_1, '|') AS stop_token_1 FROM tokenized""",
    ),
    "tokenize_documents": oracle(
        "",
        token_ctes("documents", "doc_id", "text").strip()
        + """ SELECT doc_id, len(tokens_cleaned) AS n_cleaned, len(stop_token_1) AS n_tokens,
  md5(array_to_string(stop_token_1, '|')) AS tokens_md5 FROM tokenized""",
    ),
    "detokenize": oracle(
        "messages",
        _MESSAGE_TOKENS + " SELECT msg_id, array_to_string(stop_token_1, ' ') AS message_string FROM tokenized",
    ),
    "token_class": oracle(
        "messages",
        _MESSAGE_TOKENS
        + f""", token AS (SELECT unnest(tokens_cleaned) AS t FROM tokenized)
SELECT t AS token, count(*) AS n, {_IS_URL} AS is_url, {_IS_IPV6} AS is_ipv6, {_IS_ADDRESS} AS is_address,
  {_IS_FILE} AS is_file_path, {_KIND} AS kind, {_GENERAL} AS general_kind FROM token GROUP BY t""",
    ),
    "replace_ids": oracle(
        "messages",
        _MESSAGE_TOKENS
        + f""" SELECT msg_id, array_to_string({_ids("tokens_cleaned")}, '|') AS tokens,
  array_to_string({_ids("tokens_cleaned", strict=True)}, '|') AS strict_tokens FROM tokenized""",
    ),
    "abstract_message": oracle(
        "messages",
        _MESSAGE_TOKENS
        + f",{ABSTRACT_CTE} SELECT msg_id, array_to_string(abstract_message, '|') AS abstract_message FROM abstracted",
    ),
    "mask_numbers": oracle(
        "jobs",
        r"SELECT pandaid, regexp_replace(piloterrordiag, '\b\d+\b', '((*))', 'g') AS masked FROM jobs",
    ),
    "mask_rare_words": oracle(
        "jobs",
        mask_ctes("ddmerrordiag").strip()
        + ","
        + mask_ctes("piloterrordiag")
        + """ SELECT j.pandaid, d.masked AS ddmerrordiag, p.masked AS piloterrordiag FROM jobs j
  LEFT JOIN ddmerrordiag_masked d ON d.pandaid = j.pandaid LEFT JOIN piloterrordiag_masked p ON p.pandaid = j.pandaid""",
    ),
    "mask_rare_document_words": r"""
WITH piece AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[\s]+|[^\s]+')) AS w,
    generate_subscripts(regexp_extract_all(text, '[\s]+|[^\s]+'), 1) AS pos FROM documents),
freq AS (SELECT lower(w) AS lw, count(*) AS n FROM piece WHERE regexp_matches(w, '^[^\s]') GROUP BY lower(w)),
masked AS (
  SELECT doc_id, string_agg(CASE WHEN n < 3 AND length(w) > 3 THEN '**REPLACEMENT**' ELSE w END, '' ORDER BY pos) AS t
  FROM piece LEFT JOIN freq ON lw = w GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(t, text)) AS text_md5, length(coalesce(t, text)) AS n_chars
FROM documents d LEFT JOIN masked m ON m.doc_id = d.doc_id""",
    "word_frequency": oracle(
        "jobs",
        r"""word AS (
  SELECT 'DDMERRORDIAG' AS field, unnest(string_split_regex(lower(ddmerrordiag), '\s+')) AS word FROM jobs
  UNION ALL SELECT 'PILOTERRORDIAG', unnest(string_split_regex(lower(piloterrordiag), '\s+')) FROM jobs)
SELECT field, word, count(*) AS occurrences FROM word WHERE word <> '' GROUP BY field, word""",
    ),
    "vocabulary": r"""SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS token FROM documents)
WHERE token <> ''""",
    "hostname": oracle(
        "messages",
        r"""SELECT msg_id, regexp_extract(src_hostname, '^(.*?://)?([\w.-]+).*', 2) AS src,
  regexp_extract(dst_hostname, '^(.*?://)?([\w.-]+).*', 2) AS dst FROM messages""",
    ),
    "feature_names": oracle(
        "jobs",
        """SELECT DISTINCT 'COMPUTINGSITE_' || computingsite AS name, 'COMPUTINGSITE' AS feature, computingsite AS value FROM jobs""",
    ),
}
