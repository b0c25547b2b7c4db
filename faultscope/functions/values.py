"""Column functions over times, numbers, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_SPECIFIED = "Not specified"

# The date formats accepted, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy"]

FAILED = "failed"
FINISHED = "finished"

# Payload codes of issues.
PAYLOAD_CODES = {"hpc": 2, "grid": 0}
PAYLOAD_BOTH = 1


def minute_of(epoch_ms: Column) -> Column:
    """Epoch milliseconds as a timestamp cut to the minute."""
    return F.date_trunc("minute", F.timestamp_millis(epoch_ms))


def parse_date(text: Column, strict: bool = False) -> Column:
    """Timestamp of a date in any accepted format; null otherwise, or an error if ``strict``."""
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])
    if strict:
        failure = F.raise_error(F.concat(F.lit("no valid date format found: "), text))
        return F.when(parsed.isNotNull() | text.isNull(), parsed).otherwise(
            failure.cast("timestamp")
        )
    return parsed


def or_not_specified(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NOT_SPECIFIED))


def is_failed(status: Column) -> Column:
    return F.when(status == FAILED, F.lit(1)).otherwise(F.lit(0))


def is_success(status: Column) -> Column:
    return F.when(status == FAILED, F.lit(0)).otherwise(F.lit(1))


def lost_walltime(status: Column, start: Column, end: Column, cores: Column) -> Column:
    """Core seconds lost by a failed job, 0 for others and where a time is missing."""
    used_cores = F.when(cores > 0, cores).otherwise(F.lit(1))
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    lost = F.when(status == FAILED, micros / F.lit(1e6) * used_cores)
    return F.coalesce(lost, F.lit(0.0))


def widened_start(start: Column, end: Column, minutes: int = 10) -> Column:
    """Start of the window, moved back if the window is a single instant."""
    return F.when(start == end, start - F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(start)


def widened_end(start: Column, end: Column, minutes: int = 10) -> Column:
    return F.when(start == end, end + F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(end)


def purity(failed: Column, success: Column) -> Column:
    return failed / (failed + success)


def payload_type(any_hpc: Column, any_grid: Column) -> Column:
    """2 for HPC only, 1 for both, else 0."""
    return (
        F.when(any_hpc & any_grid, F.lit(PAYLOAD_BOTH))
        .when(any_hpc, F.lit(PAYLOAD_CODES["hpc"]))
        .otherwise(F.lit(PAYLOAD_CODES["grid"]))
    )


def canonical_map(column: Column) -> Column:
    """The entries of a map as JSON in key order: equal maps give equal text."""
    return F.to_json(F.array_sort(F.map_entries(column)))


def canonical_nested_map(column: Column) -> Column:
    """The same for a map of maps."""
    entries = F.transform(
        F.map_entries(column),
        lambda e: F.struct(
            e["key"].alias("key"), F.array_sort(F.map_entries(e["value"])).alias("value")
        ),
    )
    return F.to_json(F.array_sort(entries))


def merge_counts(left: Column, right: Column) -> Column:
    """Union of two maps of maps of counts, adding the counts of equal keys."""

    def add(_: Column, a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint"))

    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(
        left,
        right,
        lambda _, a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), add),
    )


def iso_json(column: Column) -> Column:
    """A struct as JSON with ISO time stamps."""
    return F.to_json(column, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})


def cluster_uuid(run_id: str, cluster: Column) -> Column:
    """An id that stays the same for a cluster of a run."""
    return F.sha2(F.concat_ws("/", F.lit(run_id), F.coalesce(cluster.cast("string"), F.lit(""))), 256)
