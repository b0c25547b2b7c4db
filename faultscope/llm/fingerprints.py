"""Document fingerprints: content-defined chunks by a normalised gear hash, and weighted containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.words import mixed

# One number per byte value; a place's hash depends on the last 32 bytes only.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
# Chunk sizes in bytes. Before NORMAL a boundary needs STRICT bits to be zero, after it LOOSE.
LEAST, NORMAL, MOST = 16, 64, 256
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xE0000000)

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash at each byte, by doubling: sums of 1, 2, 4 … 32 shifted gear numbers."""
    total = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        more = total.copy()
        more[width:] += total[:-width] << np.uint32(width)
        total = more
    return total


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks. They depend on the bytes nearby, so an edit moves only the ends around it."""
    size = len(data)
    if not size:
        return []
    hashes = gear_hashes(data)
    loose = np.flatnonzero((hashes & LOOSE) == 0)
    strict = ((hashes[loose] & STRICT) == 0).tolist()
    places = (loose + 1).tolist()
    ends, begin = [], 0
    for place, is_strict in zip(places, strict):
        length = place - begin
        while length > MOST:
            begin += MOST
            ends.append(begin)
            length -= MOST
        if length >= NORMAL or is_strict and length >= LEAST:
            ends.append(place)
            begin = place
    while size - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < size:
        ends.append(size)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest and length of each different chunk."""
    ends = chunk_ends(data)
    begins = [0, *ends[:-1]]
    digest = xxhash.xxh3_64_intdigest
    return {digest(data[a:b]): b - a for a, b in zip(begins, ends)}


def as_text(chunks: dict[int, int]) -> str:
    """The set as text: digest and length of each chunk in hex, in order of the digests."""
    return " ".join([f"{digest:016x}{length:x}" for digest, length in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes in the different chunks of ``a`` that ``b`` has as well; empty in empty is 1."""
    if not a:
        return 0.0 if b else 1.0
    return sum(a[k] for k in a.keys() & b.keys()) / sum(a.values())


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Result rows of neighbours in order; a row is (slice, is a copy of the next slice's first, id, text)."""
    held = None
    for part, copied, doc_id, text in rows:
        chunks = chunk_set(text.encode())
        if held is not None and held[0] == part:
            yield _compared(*held[1:], text, chunks)
        held = None if copied else (part, doc_id, text, chunks)


def _compared(doc_id: int | None, text: str, chunks: dict, following: str, next_chunks: dict) -> tuple:
    changed = edited_text(text, following)
    data = changed.encode()
    edited = chunk_set(data)
    return (
        doc_id,
        len(text),
        hashlib.sha256(data).hexdigest(),
        as_text(chunks),
        as_text(edited),
        containment(chunks, edited),
        containment(chunks, next_chunks),
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("_slice", "_copied", "doc_id", "text")])

    names = [field.split()[0] for field in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    block: list[tuple] = []
    size = 0
    for row in _fingerprint_rows(rows()):
        block.append(row)
        size += len(row[3])
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names=names)
            block, size = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*block), kinds)], names=names)


def fingerprint_neighbours(
    documents: DataFrame, key: str = "doc_id", text: str = "text", slices: int | None = None
) -> DataFrame:
    """Fingerprint of each text, and its containment in its edited text and in the next document's text.

    The next document is the one with the next larger key (after the last: the first). Keys are cut
    into slices of about equal counts at approximate quantiles, four for each shuffle partition; each text is shuffled once, to its
    slice, and a copy of the first document of the following slice goes with it, so neighbours are
    always side by side and are read in order, two at a time. The cuts only decide where rows meet.

    Null texts count as empty; null keys come first; rows with equal keys are in order of their texts' digest and text.
    A single document is its own next one; no rows give no rows.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    slices = slices or 4 * parts
    shares = [i / slices for i in range(1, slices)]
    cuts = sorted(set(documents.agg(F.percentile_approx(F.col(key).cast("long"), shares)).first()[0] or []))
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    number = F.size(F.filter(cut, lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(number)
    # Order of rows with equal keys; null keys first.
    place = F.struct(
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("key"),
        F.col("doc_id").isNotNull().alias("known"),
        F.xxhash64("text").alias("digest"),
    )
    sliced = rows.withColumn("_slice", number).withColumn("_place", place)
    firsts = {r["_slice"]: r["first"] for r in sliced.groupBy("_slice").agg(F.min("_place").alias("first")).collect()}
    filled = sorted(firsts)
    before = {part: filled[i - 1] for i, part in enumerate(filled)}
    guests = spark.createDataFrame(
        [(part, before[part], firsts[part]["key"], firsts[part]["known"], firsts[part]["digest"]) for part in filled],
        "own int, guest int, key long, known boolean, digest long",
    )
    # At most one row per slice.
    guests = F.broadcast(guests)
    at = F.col("_place")
    copied = sliced.join(
        guests,
        (F.col("_slice") == F.col("own")) & (at["key"] == F.col("key")) & (at["known"] == F.col("known")) & (at["digest"] == F.col("digest")),
        "left",
    )
    homes = F.array(F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("copied")))
    away = F.array(F.struct(F.col("guest").alias("slice"), F.lit(True).alias("copied")))
    copied = copied.withColumn("_home", F.explode(F.when(F.col("guest").isNull(), homes).otherwise(F.concat(homes, away))))
    spread = copied.select(
        F.col("_home.slice").alias("_slice"), F.col("_home.copied").alias("_copied"), "_place", "doc_id", "text"
    )
    ordered = spread.repartition(parts, "_slice").sortWithinPartitions("_slice", "_copied", "_place", "text")
    return ordered.drop("_place").mapInArrow(_run, RESULT)
