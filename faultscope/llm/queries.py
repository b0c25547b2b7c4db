"""Queries over the given tables that apply the operators of this package, and their SQL statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.llm import (
    chat_format,
    decontamination,
    fill_middle,
    fingerprints,
    html_extraction,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    sharding,
    token_counts,
    toxicity,
)
from faultscope.session import scratch_path


SHARDS = 16
TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
PACKING_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    cache = scratch_path(spark, "token-counts")
    counted = token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.removed_lines(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, _table(spark, folder, "labels"))
    scored = toxicity.score_texts(documents, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, folder, "documents"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, folder, "documents"), shingle_words=4)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def benchmark_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_overlaps(documents, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        F.array_sort(F.transform("overlaps", lambda o: o["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["n_words"])), F.lit(0)).alias("longest_words"),
    )


def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    extracted = html_extraction.extract_main_text(pages)
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    planted = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.expand_examples(given.unionByName(planted)))


def _sharded(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = documents.select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ).fillna({"size": 1})
    placed = sharding.assign_shards(keyed, [1.0] * SHARDS, grown_weight=1.0)
    return sharding.add_slots(placed, tie=["doc_id", "text_crc32", "size"])


def shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _sharded(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def filled_middles(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.fill_in_middle(_table(spark, folder, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


QUERIES = {
    "op1_token_counts": token_count,
    "op2_line_dedup": repeated_lines,
    "op3_toxicity": toxicity_scores,
    "op4_chat_formatting": chat_formatting,
    "op5_fingerprints": fingerprint,
    "op6_near_duplicates": near_duplicates,
    "op7_sharding": shard_documents,
    "op8_benchmark_overlaps": benchmark_overlaps,
    "op9_source_mixing": mix_sources,
    "op10_html_extraction": main_texts,
    "op11_lexical_search": ranked_documents,
    "op12_fill_in_middle": filled_middles,
    "op13_packing": packed_documents,
}

LINE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(lines))) AS number, unnest(lines) AS line FROM split
), full_lines AS (
  SELECT doc_id, number, trim(line, ' ' || chr(9) || chr(13)) AS line FROM numbered
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), firsts AS (
  SELECT line, len(line) AS size, min(row(doc_id, number)) AS first FROM full_lines GROUP BY line
), long_lines AS (
  SELECT * FROM firsts WHERE size >= 20
), pairs AS (
  SELECT a.line, b.line AS other FROM long_lines a JOIN long_lines b ON b.size = a.size AND left(a.line, a.size // 2) = left(b.line, a.size // 2) WHERE b.first < a.first
  UNION SELECT a.line, b.line FROM long_lines a JOIN long_lines b ON b.size = a.size AND right(a.line, a.size // 2) = right(b.line, a.size // 2) WHERE b.first < a.first
  UNION SELECT a.line, b.line FROM long_lines a JOIN long_lines b ON b.size = a.size + 1 AND left(a.line, a.size // 2) = left(b.line, a.size // 2) WHERE b.first < a.first
  UNION SELECT a.line, b.line FROM long_lines a JOIN long_lines b ON b.size = a.size + 1 AND right(a.line, a.size // 2) = right(b.line, a.size // 2) WHERE b.first < a.first
  UNION SELECT a.line, b.line FROM long_lines a JOIN long_lines b ON b.size + 1 = a.size AND left(a.line, b.size // 2) = left(b.line, b.size // 2) WHERE b.first < a.first
  UNION SELECT a.line, b.line FROM long_lines a JOIN long_lines b ON b.size + 1 = a.size AND right(a.line, b.size // 2) = right(b.line, b.size // 2) WHERE b.first < a.first
), near AS (
  SELECT DISTINCT line FROM pairs WHERE levenshtein(line, other) <= 1
), marked AS (
  SELECT l.doc_id, l.number, f.first <> row(l.doc_id, l.number) OR n.line IS NOT NULL AS gone
  FROM full_lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
), counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(list(number::INTEGER ORDER BY number) FILTER (gone), []) AS removed FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, []) AS removed
FROM documents d LEFT JOIN counted USING (doc_id)
"""

CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(regexp_replace(role, '[\\#<:]', '__', 'g')) AS role_chars,
         length(regexp_replace(text, '[\\#<:]', '__', 'g')) AS text_chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + role_chars + 2 + text_chars + 9)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

SHARD_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), plain AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(doc_id::VARCHAR, '') AS key,
         hex(encode(coalesce(text, ''))) AS digits FROM documents
), summed AS (
  SELECT doc_id, size, key, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(size - 1), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM plain, bits
), costs AS (
  SELECT *, list_transform(range(17), lambda s:
    -ln((('0x' || substr(md5(key || '|' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS cost FROM summed
), placed AS (
  SELECT *, list_position(cost[1:16], list_min(cost[1:16])) - 1 AS shard, list_position(cost, list_min(cost)) - 1 AS grown FROM costs
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || '|slot'), doc_id, text_crc32, size) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM placed
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM sizes
), levels AS (
  SELECT place, 3 * source_size / weight AS most,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT coalesce(arg_min(level, place) FILTER (level <= most), 0) AS level FROM levels
), targets AS (
  SELECT source, source_size,
         CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM sizes, filled
), parts AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM targets
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
), copied AS (
  SELECT *, whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END AS copies FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM copied
"""

SEARCH_SQL = r"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counted AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM said GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), corpus AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term), corpus
), scored AS (
  SELECT a.item_id, c.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM asked a JOIN counted c USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY a.item_id, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

MIDDLE_SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), counted AS (
  SELECT *, length(text) - length(replace(text, chr(10), '')) AS ends FROM given
), lined AS (
  SELECT *, ends + (text <> '' AND NOT ends_with(text, chr(10)))::BIGINT AS n FROM counted
), chosen AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lined
), cut AS (
  SELECT *, string_split(text, chr(10)) AS lines, least(one, two) AS low, greatest(one, two) AS high FROM chosen
), placed AS (
  SELECT *, CASE WHEN low = 0 THEN 0 WHEN low > ends THEN length(text)
                 ELSE length(array_to_string(lines[1:low], chr(10))) + 1 END AS first,
         CASE WHEN high = 0 THEN 0 WHEN high > ends THEN length(text)
                 ELSE length(array_to_string(lines[1:high], chr(10))) + 1 END AS second FROM cut
), parts AS (
  SELECT *, substring(text, 1, first) AS prefix, substring(text, first + 1, second - first) AS middle,
         substring(text, second + 1) AS suffix FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

SQL = {
    "op2_line_dedup": LINE_SQL,
    "op4_chat_formatting": CHAT_SQL,
    "op7_sharding": SHARD_SQL,
    "op9_source_mixing": MIX_SQL,
    "op11_lexical_search": SEARCH_SQL,
    "op12_fill_in_middle": MIDDLE_SQL,
}
