"""Fill-in-middle: two cuts per text, sentinels between the parts, and the parts exchanged in place by rotations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.llm.arrow_columns import with_text_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Bytes that are exchanged at a time, so that a reversal needs no copy of the text.
BLOCK = 1 << 16

FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


@dataclass(frozen=True)
class Rates:
    """Percent of texts that are transformed, and of these the percent in suffix-prefix-middle order."""

    transformed: int = 100
    spm: int = 50


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Turn round the bytes from ``start`` to ``end`` where they lie."""
    while end - start > 1:
        k = min(BLOCK, (end - start) // 2)
        front, back = buffer[start : start + k], buffer[end - k : end]
        front.reverse()
        back.reverse()
        buffer[start : start + k], buffer[end - k : end] = back, front
        start, end = start + k, end - k


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring segments [start, cut) and [cut, end) by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def numbers(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that only the seed and the id decide."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def count_lines(text: bytes | bytearray) -> int:
    return text.count(b"\n") + (len(text) > 0 and text[-1] != 10)


def line_end(buffer: bytearray, start: int, n_lines: int) -> int:
    """Place after the next ``n_lines`` lines from ``start``."""
    for _ in range(n_lines):
        found = buffer.find(b"\n", start)
        start = found + 1 if found >= 0 else len(buffer)
    return start


def characters(buffer: bytearray, start: int, end: int) -> int:
    return len(buffer[start:end].decode())


def transform(text: str | None, doc_id: int | None, seed: str, rates: Rates) -> tuple:
    """(lines, form, code points of prefix and of middle, output) of one text."""
    buffer = bytearray((text or "").encode())
    n = count_lines(buffer)
    one, two, three, four = numbers(seed, doc_id)
    clash = any(mark in buffer for mark in (PREFIX, SUFFIX, MIDDLE))
    if not buffer or clash or three % 100 >= rates.transformed:
        return n, "plain", None, None, buffer.decode()
    low, high = sorted((one % (n + 1), two % (n + 1)))
    first = line_end(buffer, 0, low)
    second = line_end(buffer, first, high - low)
    sizes = characters(buffer, 0, first), characters(buffer, first, second)
    # From the last place to the first, so that the places before stay.
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if four % 100 < rates.spm:
        rotate(buffer, 0, second, len(buffer))
        return n, "spm", *sizes, buffer.decode()
    rotate(buffer, first, second, len(buffer))
    return n, "psm", *sizes, buffer.decode()


def invert(output: str, form: str) -> str:
    """The text whose output in this form is given: the same rotations backwards, then no sentinels."""
    if form == "plain":
        return output
    buffer = bytearray(output.encode())
    if form == "spm":
        # suffix, prefix, middle: the suffix goes back to the end.
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
        middle = buffer.index(MIDDLE)
        suffix = buffer.index(SUFFIX, middle)
    else:
        # prefix, suffix, middle: suffix and middle change places.
        suffix = buffer.index(SUFFIX)
        cut = buffer.index(MIDDLE, suffix)
        rotate(buffer, suffix, cut, len(buffer))
        middle, suffix = suffix, suffix + len(buffer) - cut
    for place in (suffix, middle, 0):
        del buffer[place : place + 3]
    return buffer.decode()


def fill_in_middle(
    documents: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "7", rates: Rates = Rates()
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row of ``documents``.

    A text's ``n`` lines are its units. Numbers from the SHA-256 of seed and id choose two cuts
    between lines, whether the text is transformed, and the order: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>``
    middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` the text itself, which
    empty texts and those that hold a sentinel always are. The sentinels go into one bytearray
    of the text, whose segments change places there by three reversals, a bounded block at a time.

    Null texts count as empty. A null id counts as an empty one in the seed and stays null. Repeated
    rows are transformed alike, row by row; nothing is shuffled. A text is one value in one task,
    however long. Other columns of ``documents`` are neither read nor returned, whatever their names.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The texts go to the tasks under the name of the output, which takes their place.
    shown = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    keyed = rows.select("doc_id", shown.alias("output"))

    def start():
        def transformed(texts: list[str | None]) -> list[list]:
            parts = [t.partition(":") for t in texts]
            return list(zip(*[transform(body, int(i) if i else None, seed, rates) for i, _, body in parts]))

        return transformed

    found = with_text_columns(keyed, "output", FIELDS, start)
    return found.select("doc_id", *[f.name for f in FIELDS])


def restore(transformed: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with their text rebuilt from output and form alone, as a column ``restored``.

    A column of that name is replaced, all others stay. Null output or form gives null.
    """
    framed = transformed.withColumn("restored", F.concat(F.col(form), F.lit(":"), F.col(output)))

    def start():
        def inverted(texts: list[str | None]) -> list[list]:
            parts = [t.partition(":") if t is not None else None for t in texts]
            return [[None if p is None else invert(p[2], p[0]) for p in parts]]

        return inverted

    return with_text_columns(framed, "restored", [T.StructField("restored", T.StringType())], start)
