"""Job tables: preparation, error signatures and their time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.functions import text, values
from faultscope.operators.messages import mask_rare_words

# The attributes that may explain failures, in the order they are walked.
FEATURES = [
    "COMPUTINGSITE",
    "DESTINATIONSE",
    "JEDITASKID",
    "COMPUTINGELEMENT",
    "CREATIONHOST",
    "NUCLEUS",
    "REQID",
]
# Attributes that are kept beside these.
OTHER_FEATURES = ["SITE", "PRODUSERNAME"]

# The error fields of a signature, in its order; the DDM text counts twice.
DIAG_FIELDS = [
    "DDMERRORDIAG",
    "BROKERAGEERRORDIAG",
    "DDMERRORDIAG",
    "EXEERRORDIAG",
    "JOBDISPATCHERERRORDIAG",
    "PILOTERRORDIAG",
    "SUPERRORDIAG",
    "TASKBUFFERERRORDIAG",
]
CODE_FIELDS = [
    "BROKERAGEERRORCODE",
    "DDMERRORCODE",
    "EXEERRORCODE",
    "JOBDISPATCHERERRORCODE",
    "PILOTERRORCODE",
    "SUPERRORCODE",
    "TASKBUFFERERRORCODE",
    "TRANSEXITCODE",
]

SUMS = ["ISSUCCESS", "ISFAILED", "LOSTWALLTIME"]


def select_features(jobs: DataFrame, features: list[str]) -> DataFrame:
    """All columns, with the features as text and ``Not specified`` for nulls."""
    filled = {f: values.or_not_specified(F.col(f)) for f in features}
    return jobs.withColumns(filled)


def with_outcome(jobs: DataFrame) -> DataFrame:
    """Adds ISSUCCESS and ISFAILED."""
    return jobs.withColumns(
        {
            "ISSUCCESS": values.is_success(F.col("JOBSTATUS")),
            "ISFAILED": values.is_failed(F.col("JOBSTATUS")),
        }
    )


def with_lost_walltime(jobs: DataFrame) -> DataFrame:
    """Adds LOSTWALLTIME, core seconds."""
    lost = values.lost_walltime(
        F.col("JOBSTATUS"), F.col("STARTTIME"), F.col("ENDTIME"), F.col("ACTUALCORECOUNT")
    )
    return jobs.withColumn("LOSTWALLTIME", lost)


def with_signature(
    jobs: DataFrame, diag_fields: list[str], code_fields: list[str], width: int | None = None
) -> DataFrame:
    """Adds ``combinederrors``, equal for jobs with equal error fields."""
    fields = [F.col(f) for f in [*diag_fields, *code_fields]]
    return jobs.withColumn("combinederrors", text.error_signature(fields, width))


def prepare_jobs(
    jobs: DataFrame,
    features: list[str] = FEATURES,
    diag_fields: list[str] = DIAG_FIELDS,
    code_fields: list[str] = CODE_FIELDS,
    other_features: list[str] = OTHER_FEATURES,
    id_col: str = "PANDAID",
    width: int | None = None,
) -> DataFrame:
    """The job frame that the analysis works on: filled features, outcome, lost time, masked
    error texts and the error signature."""
    texts = list(dict.fromkeys([*diag_fields, *code_fields]))
    kept = list(dict.fromkeys([*features, *other_features]))
    frame = with_lost_walltime(with_outcome(jobs))
    frame = select_features(frame, [*kept, *texts]).select(
        id_col, "JOBSTATUS", "STARTTIME", "ENDTIME", *SUMS, *kept, *texts
    )
    masked = mask_rare_words(frame, list(dict.fromkeys(diag_fields)), id_col)
    return with_signature(masked, diag_fields, code_fields, width)


# -- signatures -----------------------------------------------------------------------------


def signature_frequency(jobs: DataFrame, minutes: int = 10) -> DataFrame:
    """Successes, failures, loss and time window of every signature."""
    return (
        jobs.groupBy("combinederrors")
        .agg(
            F.sum("ISSUCCESS").alias("n_success"),
            F.sum("ISFAILED").alias("n_failed"),
            F.sum("LOSTWALLTIME").alias("walltime_loss"),
            F.min("ENDTIME").alias("first_end"),
            F.max("ENDTIME").alias("last_end"),
        )
        .select(
            "combinederrors",
            "n_success",
            "n_failed",
            "walltime_loss",
            values.widened_start(F.col("first_end"), F.col("last_end"), minutes).alias("window_start"),
            values.widened_end(F.col("first_end"), F.col("last_end"), minutes).alias("window_end"),
        )
    )


def top_signatures(frequency: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` signatures with the largest loss and the ``n`` with the most failures."""
    by_loss = frequency.orderBy(F.desc("walltime_loss"), "combinederrors").limit(n)
    by_failures = frequency.orderBy(F.desc("n_failed"), "combinederrors").limit(n)
    return by_loss.union(by_failures).distinct()


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(time) / F.lit(seconds))


def signature_slice(
    jobs: DataFrame, windows: DataFrame, margin_minutes: int = 20, bucket_seconds: int = 3600
) -> DataFrame:
    """The jobs to look at for each signature: its own jobs inside its window, and finished jobs
    of any signature inside the window widened by the margin.

    Adds ``slice``, the signature of the window. Windows are spread over time buckets, so this is
    an equi-join on the bucket and each job meets only windows that are open in its bucket.
    """
    margin = F.expr(f"INTERVAL {margin_minutes} MINUTES")
    open_windows = windows.select(
        F.col("combinederrors").alias("slice"),
        F.col("window_start").alias("_from"),
        F.col("window_end").alias("_to"),
        F.explode(
            F.sequence(
                _bucket(F.col("window_start") - margin, bucket_seconds),
                _bucket(F.col("window_end") + margin, bucket_seconds),
            )
        ).alias("_bucket"),
    )
    end = F.col("ENDTIME")
    own = (F.col("combinederrors") == F.col("slice")) & end.between(F.col("_from"), F.col("_to"))
    finished = (F.col("JOBSTATUS") == values.FINISHED) & end.between(
        F.col("_from") - margin, F.col("_to") + margin
    )
    return (
        jobs.withColumn("_bucket", _bucket(end, bucket_seconds))
        .join(open_windows, "_bucket")
        .filter(own | finished)
        .drop("_bucket", "_from", "_to")
    )


def slice_cells(
    jobs: DataFrame,
    windows: DataFrame,
    features: list[str] = FEATURES,
    margin_minutes: int = 20,
) -> DataFrame:
    """The slices of all signatures, added up per combination of feature values.

    The window edges cut the time line into segments (two cuts for the window and two for the
    widened one, per signature). Jobs are first added up per segment, outcome, signature and
    features – map-side, before any shuffle – and only these sums meet the windows, of which a
    finished job may belong to all. ``windows`` comes from ``top_signatures`` and so has at most
    twice its ``n`` rows, which bounds the array of cuts.

    Columns: slice, own (is a job of the signature itself), features, sums, first and last end.
    """
    micros = 60_000_000 * margin_minutes
    edges = windows.select(
        F.col("combinederrors").alias("slice"),
        F.unix_micros("window_start").alias("_from"),
        (F.unix_micros("window_end") + 1).alias("_to"),
    )
    cuts = edges.select(
        F.explode(
            F.array(
                "_from",
                "_to",
                F.col("_from") - micros,
                F.col("_to") + micros,
            )
        ).alias("cut")
    ).agg(F.sort_array(F.collect_set("cut")).alias("cuts"))

    def segment(time: Column) -> Column:
        return F.size(F.filter(F.col("_cuts"), lambda cut: cut <= time))

    selected = edges.select(F.col("slice").alias("_signature"))
    relevant = (
        jobs.withColumn("_cuts", cuts.scalar())
        .withColumn("_segment", segment(F.unix_micros("ENDTIME")))
        .join(selected, F.col("combinederrors") == F.col("_signature"), "left")
        .withColumn("_finished", F.col("JOBSTATUS") == values.FINISHED)
        .filter(F.col("_finished") | F.col("_signature").isNotNull())
    )
    cells = relevant.groupBy("_segment", "_signature", "_finished", *features).agg(
        F.sum("ISFAILED").alias("n_failed"),
        F.sum("ISSUCCESS").alias("n_success"),
        F.sum("LOSTWALLTIME").alias("walltime_loss"),
        F.min("ENDTIME").alias("first_end"),
        F.max("ENDTIME").alias("last_end"),
    )
    open_segments = edges.withColumn("_cuts", cuts.scalar()).select(
        "slice",
        segment(F.col("_from")).alias("_first"),
        segment(F.col("_to") - 1).alias("_last"),
        F.explode(
            F.sequence(
                segment(F.col("_from") - micros),
                segment(F.col("_to") - 1 + micros),
            )
        ).alias("_segment"),
    )
    own = F.coalesce(F.col("_signature") == F.col("slice"), F.lit(False)) & F.col(
        "_segment"
    ).between(F.col("_first"), F.col("_last"))
    return (
        cells.join(open_segments, "_segment")
        .withColumn("own", own)
        .filter(F.col("own") | F.col("_finished"))
        .groupBy("slice", "own", *features)
        .agg(
            F.sum("n_failed").alias("n_failed"),
            F.sum("n_success").alias("n_success"),
            F.sum("walltime_loss").alias("walltime_loss"),
            F.min("first_end").alias("first_end"),
            F.max("last_end").alias("last_end"),
        )
    )


def window_errors(jobs: DataFrame, windows: DataFrame, diag_fields: list[str] = DIAG_FIELDS) -> DataFrame:
    """Error texts of each signature: for every field that is set, its text and the number of the
    signature's jobs in its window, as ``map<field, map<text, count>>``.

    Jobs of one signature share their (masked) texts.
    """
    own = jobs.join(
        windows.select(F.col("combinederrors").alias("slice"), "window_start", "window_end"),
        (F.col("combinederrors") == F.col("slice"))
        & F.col("ENDTIME").between(F.col("window_start"), F.col("window_end")),
    )
    fields = list(dict.fromkeys(diag_fields))
    texts = own.groupBy("slice").agg(
        F.count("*").alias("n"), *[F.min(f).alias(f) for f in fields]
    )
    entries = F.array(
        *[
            F.when(
                F.col(f) != values.NOT_SPECIFIED,
                F.struct(F.lit(f).alias("key"), F.create_map(F.col(f), F.col("n")).alias("value")),
            )
            for f in fields
        ]
    )
    return texts.select(
        "slice",
        F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("error_strings"),
    )
