"""Chat formatting: prefix-target expansion with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template. A turn is OPEN role MIDDLE text CLOSE.
OPEN = "### "
MIDDLE = ": "
CLOSE = " </turn>\n"
# The escape sign and the signs that control strings begin with or are found by, with their codes.
# The escape sign comes first: it is escaped before and restored after all others.
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column) -> Column:
    """Text without any sign that a control string could start with."""
    for sign, code in CODES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    for sign, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def expand_examples(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """One example per turn of the ``target`` role: all turns before it as context, that reply as the only loss.

    Returns ``conv_id, example, n_turns, text, loss_start, loss_length``; the mask is a span of code
    points of the example's text. Turns after the last reply would be in no example, so a
    conversation that doesn't end with a reply gets one more example, with loss_length 0, that holds all of it.
    ``last`` marks the example that holds the whole conversation.

    Turns are in order of (turn, role, text), nulls first; null roles and texts count as empty, null
    ids are one conversation, repeated rows are turns of their own. A conversation becomes one row,
    as its longest example must; the lists of its turns are begun before the shuffle.
    """
    said = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
    whole = whole.select(
        "conv_id",
        F.size("said").alias("size"),
        F.transform("said", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(CLOSE))).alias("parts"),
        F.transform("said", lambda t: t["role"] == target).alias("is_target"),
        F.transform("said", lambda t: F.length(head(t))).alias("head"),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.col("size")), lambda i: F.element_at("is_target", i) | (i == F.col("size"))
    )
    # The positions are exploded, not the examples: one example at a time is built from the parts.
    one = whole.select("*", F.posexplode(ends).alias("example", "n_turns"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns") - 1), "")
    part = F.element_at("parts", F.col("n_turns"))
    trained = F.element_at("is_target", F.col("n_turns"))
    start = F.length(context) + F.element_at("head", F.col("n_turns"))
    length = F.length(part) - F.element_at("head", F.col("n_turns")) - len(CLOSE)
    return one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat(context, part).alias("text"),
        start.cast("long").alias("loss_start"),
        F.when(trained, length).otherwise(0).cast("long").alias("loss_length"),
        (F.col("n_turns") == F.col("size")).alias("last"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of an example's text."""
    parts = F.split(text, F.lit(CLOSE), F.lit(-1))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        middle = F.instr(part, MIDDLE)
        role = F.substr(part, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(part, middle + len(MIDDLE))).alias("text"))

    return F.transform(parts, turn)


def loss_text(example: Column, start: Column, length: Column) -> Column:
    """The text under the mask, unescaped."""
    return unescaped(F.substr(example, (start + 1).cast("int"), length.cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Read back from the examples: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    The turns come from the example that holds the whole conversation, the loss from all examples in order.
    """
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select(
        "conv_id",
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss")).alias("loss"),
        F.size(turns).alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.when(F.col("last"), F.length("text")).alias("formatted_chars"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["loss"]), "").alias("loss"),
        F.max("formatted_chars").cast("long").alias("formatted_chars"),
    )
    return per.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
