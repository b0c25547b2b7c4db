"""Shapes of physical plans that matter at scale."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultscope.session import scratch_path
from faultscope.sources import files

FOLDER = "/root/testdata/sf0.001"
NAMES = ["signature_slice_rows", "issue_rows", "issue_overlap", "payload_class", "log_issues", "site_lookup", "top_patterns", "upsert_issues"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_join_without_keys(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["top_patterns", "top_reason", "cluster_token_freq"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, FOLDER))


def test_job_window_reaches_the_scan(spark):
    path = scratch_path(spark, "jobs")
    now = datetime.datetime(2024, 1, 1)
    spark.createDataFrame(
        [(1, 2, "failed", "managed", now, now, now, "unused")],
        "PANDAID bigint, JEDITASKID bigint, JOBSTATUS string, PRODSOURCELABEL string, STARTTIME timestamp, "
        "ENDTIME timestamp, MODIFICATIONTIME timestamp, JOBNAME string",
    ).write.parquet(path)
    # Plans shorten long lists of filters by default.
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    window = files.job_window(spark.read.parquet(path), now, now).agg(F.max("PANDAID"))
    scan = next(line for line in plan(window).splitlines() if "FileScan" in line)
    pushed = scan.split("PushedFilters: ")[1]
    for condition in ("GreaterThan(ENDTIME", "LessThan(STARTTIME", "GreaterThan(MODIFICATIONTIME"):
        assert condition in pushed
    assert "JOBNAME" not in scan


def test_spread_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, cores)
    assert files.spread(wide) is wide
    assert files.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
