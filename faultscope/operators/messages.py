"""Token columns of message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.functions import text
from faultscope.functions.values import NOT_SPECIFIED

# A word is rare below this count, and replaced from this length on.
RARE_WORD_COUNT = 3
RARE_WORD_LENGTH = 4

TRANSFER_COLUMNS = ["t__error_message", "src_hostname", "dst_hostname"]


def flatten_select(
    log: DataFrame,
    id_col: str = "msg_id",
    time_col: str = "timestamp_tr_comp",
    only_failed: bool = False,
    vo: str | None = None,
) -> DataFrame:
    """The columns of a nested transfer log that the clustering needs."""
    flat = log.select("data.*")
    if only_failed:
        flat = failed_transfers(flat)
    if vo is not None:
        flat = flat.filter(F.col("vo") == vo)
    return flat.select(id_col, *TRANSFER_COLUMNS, time_col)


def failed_transfers(log: DataFrame, flag_col: str = "t_final_transfer_state_flag") -> DataFrame:
    return log.filter(F.col(flag_col) == 0)


def tokenize_messages(
    messages: DataFrame,
    message_col: str = "t__error_message",
    id_col: str = "msg_id",
    tokens_col: str = "stop_token_1",
    keep_bare_host: bool = False,
) -> DataFrame:
    """Message, its URL-separated form, and its tokens after each cleaning step."""
    return (
        messages.select(id_col, message_col)
        .withColumn("corrected_message", text.split_urls(F.col(message_col), keep_bare_host))
        .withColumn("tokens", text.lower_tokens(F.col("corrected_message")))
        .withColumn("tokens_cleaned", text.clean_tokens(F.col("tokens")))
        .withColumn("stop_token", text.remove_english(F.col("tokens_cleaned")))
        .withColumn(tokens_col, text.remove_empty(F.col("stop_token")))
    )


def detokenize_messages(
    tokenized: DataFrame, tokens_col: str, out_col: str = "message_string"
) -> DataFrame:
    return tokenized.withColumn(out_col, text.detokenize(F.col(tokens_col)))


def abstract_messages(
    tokenized: DataFrame,
    tokens_col: str = "tokens_cleaned",
    out_col: str = "abstract_message",
    strict_message_id: bool = False,
) -> DataFrame:
    """Tokens with parameters and identifiers replaced by their kind."""
    replaced = f"_{out_col}"
    return (
        tokenized.withColumn(replaced, text.replace_token_parameters(F.col(tokens_col)))
        .withColumn(
            out_col,
            text.replace_ids(F.col(replaced), strict_message_id=strict_message_id),
        )
        .drop(replaced)
    )


def vocabulary(tokenized: DataFrame, tokens_col: str = "stop_token_1") -> DataFrame:
    """The distinct tokens."""
    return tokenized.select(F.explode(tokens_col).alias("token")).distinct()


def word_frequency(frame: DataFrame, text_cols: list[str]) -> DataFrame:
    """Occurrences of every case-folded word, per text column."""
    return (
        _field_texts(frame, text_cols)
        .select("field", F.explode(text.words(F.lower("text"))).alias("word"))
        .groupBy("field", "word")
        .agg(F.count("*").alias("occurrences"))
    )


def _field_texts(frame: DataFrame, text_cols: list[str], *kept: str) -> DataFrame:
    fields = [
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in text_cols
    ]
    return frame.select(*kept, F.inline(F.array(*fields)))


def mask_rare_words(frame: DataFrame, text_cols: list[str], id_col: str) -> DataFrame:
    """Replace the rare words of each text column by a fixed mark, keeping white space.

    A word is rare if its case-folded form occurs less than three times in its column; only
    lower-case words of more than three characters are replaced. ``id_col`` is an integer id.

    A rare word stands at two places at most. These are the places at the smallest and the largest row
    id, or the first and the last place where both are in one row, of the aggregate that counts the word. Its
    buffers are numbers, so words are added up by hash without a sort. Frequent words collapse before the
    shuffle and never meet a join: the only join is on the row id, and brings each row its sorted places.
    """
    # A row without id has no place to mask; its words count.
    known = F.when(F.col("_id").isNotNull(), F.col("_place"))
    one_row = F.col("least") == F.col("most")
    first = F.struct(F.col("least").alias("_id"), F.when(one_row, F.col("top")).otherwise(F.col("at_least")).alias("_place"))
    last = F.struct(F.col("most").alias("_id"), F.when(one_row, F.col("bottom")).otherwise(F.col("at_most")).alias("_place"))
    places = (
        _field_texts(frame, text_cols, F.col(id_col).alias("_id"))
        .filter(F.col("text") != NOT_SPECIFIED)
        .select("_id", "field", F.posexplode(text.words(F.lower("text"))).alias("_place", "word"))
        .groupBy("field", "word")
        .agg(
            F.count("*").alias("n"),
            F.min("_id").alias("least"),
            F.max("_id").alias("most"),
            F.min_by("_place", "_id").alias("at_least"),
            F.max_by("_place", "_id").alias("at_most"),
            F.min(known).alias("top"),
            F.max(known).alias("bottom"),
        )
        .filter((F.col("n") < RARE_WORD_COUNT) & (F.length("word") >= RARE_WORD_LENGTH))
        .select("field", F.explode(F.array_distinct(F.array(first, last))).alias("_at"))
        .groupBy("_at._id")
        .agg(
            *[
                F.sort_array(F.collect_list(F.when(F.col("field") == c, F.col("_at._place")))).alias(f"_places_{i}")
                for i, c in enumerate(text_cols)
            ]
        )
    )
    joined = frame.join(places, frame[id_col] == places["_id"], "left")
    parts = {
        f"_parts_{i}": F.when(F.size(f"_places_{i}") > 0, text.text_parts(F.col(c).cast("string")))
        for i, c in enumerate(text_cols)
    }
    masked = {
        c: F.when(F.size(f"_places_{i}") > 0, text.mask_places(F.col(f"_parts_{i}"), F.col(f"_ends_{i}"))).otherwise(F.col(c))
        for i, c in enumerate(text_cols)
    }
    found = [f"_places_{i}" for i in range(len(text_cols))]
    split = joined.select(*[frame[c] for c in frame.columns], *found, *[p.alias(n) for n, p in parts.items()])
    ends = [text.place_ends(F.col(f"_parts_{i}"), F.col(n)).alias(f"_ends_{i}") for i, n in enumerate(found)]
    split = split.select("*", *ends)
    return split.select(*[masked[c].alias(c) if c in masked else F.col(c) for c in frame.columns])
