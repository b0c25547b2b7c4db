"""Sharding: weighted rendezvous hashing of stable record keys, with gapless slots in each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.names import fresh

# 13 hex digits are 52 bits: a uniform number strictly between 0 and 1 without rounding.
DIGITS = 13
SLICE_DIGITS = 3


def _digest(key: Column, salt: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), salt).cast("binary"))


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(_digest(key, shard.cast("string")), 1, DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(16**DIGITS)) / weight


def best_shard(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of the shard with the lowest cost; a shard wins as often as its weight says.

    The cost depends on the key, the shard's number and its own weight alone. A further shard can
    only win rows for itself, and a removed one only gives up its own.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    costs = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(_cost(key, s, F.element_at(table, s + 1)).alias("cost"), s.alias("shard")),
    )
    return F.array_min(costs)


def assign_shards(
    records: DataFrame, weights: Sequence[float] = (1.0,) * 16, key: str = "doc_id", grown_weight: float | None = None
) -> DataFrame:
    """Add ``shard`` (int) and, with ``grown_weight``, ``grown_shard``: the shard with one more of that weight.

    No shuffle: each row is placed by its key alone. Rows with equal keys share a shard, null keys as
    well (as an empty key does). Columns of these names in the input are replaced. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    columns = [c for c in records.columns if c not in ("shard", "grown_shard")]
    [best] = fresh(records, "best")
    placed = records.select(*columns, best_shard(F.col(key), weights).alias(best))
    out = [*columns, F.col(f"{best}.shard").cast("int").alias("shard")]
    if grown_weight is not None:
        cost = _cost(F.col(key), F.lit(len(weights)), F.lit(float(grown_weight)))
        grown = F.when(cost < F.col(f"{best}.cost"), F.lit(len(weights))).otherwise(F.col(f"{best}.shard"))
        out.append(grown.cast("int").alias("grown_shard"))
    return placed.select(*out)


def add_slots(records: DataFrame, key: str = "doc_id", tie: Sequence[str] = ()) -> DataFrame:
    """Add ``slot`` (long): the row's place in its ``shard``, from 0 without gaps, in order of the key's digest.

    Rows of a shard are counted by slices of the digest, the slices' sums give each slice its first
    slot, and only rows of one slice of one shard are ordered together. Rows that agree in the key
    and in ``tie`` take their slots in any order.
    """
    columns = [c for c in records.columns if c != "slot"]
    own, part, of, named, n, first, place = fresh(records, "digest", "part", "of", "named", "n", "first", "place")
    digest = _digest(F.col(key), F.lit("slot"))
    sliced = records.select(*columns, digest.alias(own), F.substring(digest, 1, SLICE_DIGITS).alias(part))
    counts = sliced.groupBy("shard", part).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(of).orderBy(named)) - F.col(n)
    starts = counts.select(F.col("shard").alias(of), F.col(part).alias(named), n).withColumn(first, before)
    placed = sliced.join(starts, (F.col("shard") == F.col(of)) & (F.col(part) == F.col(named)))
    within = F.row_number().over(Window.partitionBy("shard", part).orderBy(own, *tie)) - 1
    return placed.withColumn(place, within).select(*columns, (F.col(first) + F.col(place)).alias("slot"))


def write_shards(records: DataFrame, path: str) -> None:
    """Write sharded records as Parquet, one folder per shard; rows of a shard come from many tasks."""
    records.write.partitionBy("shard").mode("error").parquet(path)
