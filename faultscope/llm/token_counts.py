"""Token counts through a digest cache: only distinct texts that the cache doesn't know are encoded."""

from __future__ import annotations

import hashlib
import pathlib
from collections.abc import Callable
from importlib.metadata import version

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import with_text_columns

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
LIBRARIES = {".model": "sentencepiece", ".json": "tokenizers"}


def load_tokenizer(path: str) -> tuple[str, bytes, str]:
    """(library, file content, digest of content, library and its version) of a vocabulary file."""
    library = LIBRARIES[pathlib.Path(path).suffix]
    content = pathlib.Path(path).read_bytes()
    mark = f"{library} {version(library)}\n".encode()
    return library, content, hashlib.sha256(mark + content).hexdigest()


def counter(library: str, content: bytes) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, without begin, end or added special tokens and without truncation."""
    if library == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for one tokenizer version; none if there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    stored = stored.filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    documents: DataFrame, tokenizer_path: str, cache: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token count of each text: ``doc_id, n_bytes, n_tokens``, one row per row of ``documents``.

    Content is normalised by turning null into the empty text, no further, as any other change could
    change the count. Its SHA-256 is joined to the counts stored in the folder ``cache`` for this
    tokenizer version. Of each unknown content one copy is encoded, and its count is appended to
    the cache; then all rows take their counts from there. Only digests and counts are shuffled for
    copies. Appending twice, as two runs at a time or a repeated one may, does no harm.

    The vocabulary file is read on the driver and goes with the tasks. Null keys and repeated rows
    are rows as all others. The result reads the cache, which must stay until it is used.
    """
    spark = documents.sparkSession
    library, vocabulary, tokenizer = load_tokenizer(tokenizer_path)
    keyed = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = keyed.groupBy("content").agg(F.min("doc_id").alias("first"))
    misses = copies.join(read_cache(spark, cache, tokenizer).select("content"), "content", "left_anti")
    misses = misses.withColumnRenamed("content", "missing")
    texts = keyed.join(
        misses, (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi"
    )

    def start():
        count = counter(library, vocabulary)
        return lambda part: [count(part)]

    counted = with_text_columns(texts.select("content", "text"), "text", [T.StructField("n_tokens", T.LongType())], start)
    # The same content stands there once more where a key has it in several rows.
    counted = counted.select("content", "n_tokens").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    sized = keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(read_cache(spark, cache, tokenizer), "content").select("doc_id", "n_bytes", "n_tokens")
