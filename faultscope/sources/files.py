"""Reading logs, job tables and registries."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.functions import text

# The fields of a transfer log line, all inside one struct.
TRANSFER_FIELDS = T.StructType(
    [
        T.StructField("msg_id", T.LongType()),
        T.StructField("t__error_message", T.StringType()),
        T.StructField("src_hostname", T.StringType()),
        T.StructField("dst_hostname", T.StringType()),
        T.StructField("src_site_name", T.StringType()),
        T.StructField("dst_site_name", T.StringType()),
        T.StructField("tr_error_category", T.StringType()),
        T.StructField("t_final_transfer_state_flag", T.IntegerType()),
        T.StructField("timestamp_tr_comp", T.LongType()),
        T.StructField("vo", T.StringType()),
    ]
)
TRANSFER_LOG = T.StructType([T.StructField("data", TRANSFER_FIELDS)])

PROTOCOLS = "map<string,struct<endpoint:string>>"


def read_json(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | None = TRANSFER_LOG
) -> DataFrame:
    """JSON lines of one path or several, with a declared schema (no inference pass)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def read_json_tree(
    spark: SparkSession, folder: str, schema: T.StructType | None = TRANSFER_LOG
) -> DataFrame:
    """Every file below a folder, as one scan."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader if schema is None else reader.schema(schema)).json(folder)


def spread(frame: DataFrame) -> DataFrame:
    """The rows over all cores, if the input has fewer partitions than the session has cores (one
    small file, one row group). Larger inputs stay as they are, without a shuffle."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def day_path(base: str, day: datetime.date, today: datetime.date | None = None) -> str:
    """``base/YYYY/MM/DD/``, or ``base/YYYY/MM/DD.tmp/`` for the day still being written."""
    return f"{base.rstrip('/')}/{day:%Y/%m/%d}{'.tmp' if day == today else ''}/"


def day_paths(
    base: str, first: datetime.date, last: datetime.date, today: datetime.date | None = None
) -> list[str]:
    days = (last - first).days + 1
    return [day_path(base, first + datetime.timedelta(days=i), today) for i in range(days)]


def fetch(
    spark: SparkSession,
    source_type: str,
    path: str | list[str] | None = None,
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Read by type: JSON, parquet, ORC, CSV, or a JDBC table through its options."""
    reader = spark.read.format(source_type.lower()).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def load_with_snapshot(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    translate: Callable[[DataFrame], DataFrame],
    snapshot: str | None = None,
) -> DataFrame:
    """Read and translate; keep the result at ``snapshot`` and fall back to it on failure.

    Each run writes its own folder, which Spark commits as a whole, so an aborted run leaves no
    rows behind; the newest run is the current one.
    """
    if snapshot is None:
        return translate(read())
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    target = f"{snapshot.rstrip('/')}/run={stamp}"
    try:
        translate(read()).write.parquet(target)
    except (PySparkException, Py4JJavaError) as failure:
        try:
            return newest_snapshot(spark, snapshot)
        except AnalysisException:
            raise failure from None
    return spark.read.parquet(target)


def newest_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    runs = spark.read.parquet(snapshot)
    newest = runs.agg(F.max("run")).scalar()
    return runs.filter(F.col("run") == newest).drop("run")


def job_scan(
    jobs: DataFrame,
    tasks: DataFrame,
    date_from: datetime.datetime,
    date_to: datetime.datetime,
    label: str | None = "managed",
    has_modification_time: bool = True,
) -> DataFrame:
    """Finished and failed jobs that overlap the window, with the site of their task.

    The comparisons stand on the bare columns, so they reach the file or database scan. The task
    table is unique per task; Spark chooses the join by its size.
    """
    window = job_window(jobs, date_from, date_to, label, has_modification_time)
    return window.join(tasks, "JEDITASKID", "inner")


def job_window(
    jobs: DataFrame,
    date_from: datetime.datetime,
    date_to: datetime.datetime,
    label: str | None = "managed",
    has_modification_time: bool = True,
    unstarted: bool = False,
) -> DataFrame:
    """Finished and failed jobs that end after the window's start and start before its end. With ``unstarted``, jobs that failed
    before they started count by their end; else they drop out."""
    begun = F.coalesce("STARTTIME", "ENDTIME") if unstarted else F.col("STARTTIME")
    condition = (
        F.col("JOBSTATUS").isin("failed", "finished")
        & F.col("ENDTIME").isNotNull()
        & (F.col("ENDTIME") > F.lit(date_from))
        & (begun < F.lit(date_to))
    )
    if label is not None:
        condition &= F.col("PRODSOURCELABEL") == label
    if has_modification_time:
        condition &= F.col("MODIFICATIONTIME") > F.lit(date_from)
    return jobs.filter(condition)


def trailing_window(
    frame: DataFrame, time_col: str, as_of: datetime.datetime | Column, hours: float
) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of`` (inclusive); never the wall clock."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    span = F.make_dt_interval(secs=F.lit(float(hours) * 3600.0))
    return frame.filter((F.col(time_col) >= end - span) & (F.col(time_col) <= end))


def read_registry(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    """Registry as JSON lines ``{"site": …, "protocols": {name: {"endpoint": …}}}``.

    ``grouped`` reads the other form, where each site lists several storage elements under
    ``elements``. Result: ``pos, site, endpoint`` in file order of the endpoints.
    """
    body = f"array<struct<protocols:{PROTOCOLS}>>" if grouped else PROTOCOLS
    column = "elements" if grouped else "protocols"
    lines = spark.read.schema(f"site string, {column} {body}").json(path)
    return registry_endpoints(lines, grouped)


def parse_registry(document: Column, grouped: bool = False) -> Column:
    """One JSON document ``{site: …}`` as an array of (site, protocols or elements)."""
    if grouped:
        kind = f"map<string,array<struct<protocols:{PROTOCOLS}>>>"
        name = "elements"
    else:
        kind, name = f"map<string,struct<protocols:{PROTOCOLS}>>", "protocols"
    entries = F.map_entries(F.from_json(document, kind))
    return F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("site"),
            (e["value"] if grouped else e["value"]["protocols"]).alias(name),
        ),
    )


def registry_endpoints(lines: DataFrame, grouped: bool = False) -> DataFrame:
    """Endpoints of a registry with a running position (file, then place in the line)."""
    if grouped:
        lines = lines.select(
            "site",
            F.posexplode("elements").alias("_element", "_body"),
        ).select("site", "_element", F.col("_body.protocols").alias("protocols"))
    else:
        lines = lines.withColumn("_element", F.lit(0))
    return lines.select(
        "site",
        "_element",
        F.posexplode(F.map_entries("protocols")).alias("_place", "_entry"),
    ).select(
        F.struct("site", "_element", "_place").alias("pos"),
        "site",
        F.col("_entry.value.endpoint").alias("endpoint"),
    )


def host_sites(endpoints: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Site of every host; the first endpoint of a host decides."""
    return (
        endpoints.select(text.hostname(F.col("endpoint")).alias("hostname"), "site", pos_col)
        .groupBy("hostname")
        .agg(F.min_by("site", pos_col).alias("site"))
    )
