"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.names import fresh
from faultscope.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# The first 15 of the 32 hex digits of a digest are a number below 2**60; 12 bits of it name a slice.
DIGITS = 15
SLICE_BITS = 12


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 without a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_key(key: Column, seed: int) -> Column:
    """A seeded number from 0 to 2**60 for a record key; the same key gives the same number always."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weight of each ``source`` by its place in code point order, null last; one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    return sources.select("source").distinct().withColumn("weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target``: words that the mix takes from each row of (source, weight, source_size).

    The sum of all sizes is shared by weight. A source whose share is above ``max_epochs`` times its
    size is clamped there and the rest is shared again among the others by weight, until no share
    is above. Shares only rise from round to round, so a clamped source stays clamped, and every
    round but the last clamps one source at least. A round is one sum over the table of sources.

    Sources with a null, zero or negative weight get nothing. An empty table stays empty.
    """
    sources = cut_lineage(sources)
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0))
    limit = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = weight * F.lit(level) > limit
        clamped, open_weight = sources.agg(
            F.sum(F.when(full & (level >= 0), limit)), F.sum(F.when(~full | F.lit(level < 0), weight))
        ).first()
        risen = (total - (clamped or 0)) / open_weight if open_weight else max(level, 0.0)
        if risen <= level:
            break
        level = risen
    share = weight * F.lit(level)
    return sources.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share.cast("double")))


def mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies``.

    ``weights`` has (source, weight); without it all sources cycle through 1, 2, 3. A source's target
    is met by whole repetitions of all its documents and, for the rest, by one more repetition of the
    documents that come first in a seeded order of their keys, up to the document at whose middle
    the rest is used up. So a source misses its target by half a document at most, and nothing is
    taken more than ``max_epochs`` times. The order is followed by slices of the key's number: sums
    per source and slice first, then rows within one slice, so no source is in one task.

    Null texts have size 0, null sources are one source, null keys share one number; repeated rows
    count as often as they stand there. No rows give no rows.
    """
    sized = documents.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    ).withColumn("u", sample_key(F.col("doc_id"), seed))
    sized = sized.withColumn("slice", F.shiftright("u", 4 * DIGITS - SLICE_BITS))
    slices = cut_lineage(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    if weights is None:
        weights = cycled_weights(sizes)
    weights = weights.select(F.col("source").alias("named"), "weight")
    shared = sizes.join(weights, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    targets = water_fill(shared, max_epochs)
    rate = F.try_divide("target", "source_size")
    targets = targets.withColumn("whole", F.coalesce(F.floor(rate), F.lit(0))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    earlier = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    before = slices.withColumn("before", earlier).drop("slice_size")
    before = before.join(
        targets.select(F.col("source").alias("named"), "source_size", "target", "whole", "rest"),
        F.col("source").eqNullSafe(F.col("named")),
    ).drop("named")
    before = before.withColumnsRenamed({"source": "named", "slice": "named_slice"})
    placed = sized.join(
        before, F.col("source").eqNullSafe(F.col("named")) & (F.col("slice") == F.col("named_slice"))
    ).drop("named", "named_slice")
    order = Window.partitionBy("source", "slice").orderBy("u", "doc_id", "size")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = F.col("before") + within + F.col("size") / 2
    extra = F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    return placed.withColumn("copies", (F.col("whole") + extra).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies"
    )


def repeat_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with its own columns.

    Rows that share a key share the copies that ``mix`` gives to all of them, as evenly as they divide.
    """
    named, copies, rows, place, times = fresh(documents, "named", "copies", "rows", "place", "times")
    taken = mix(documents, key=key, text=text, **options).groupBy(F.col("doc_id").alias(named)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)
    )
    joined = documents.join(taken, F.col(key).eqNullSafe(F.col(named)))
    order = F.row_number().over(Window.partitionBy(named).orderBy(F.xxhash64(text)))
    share = F.floor(F.col(copies) / F.col(rows)).cast("int")
    more = (F.col(place) <= F.col(copies) % F.col(rows)).cast("int")
    shared = joined.withColumn(place, order).withColumn(times, share + more).filter(F.col(times) > 0)
    return shared.select(*documents.columns, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*documents.columns)
