"""Registering issues on the stream: like the batch form, whatever the batches, and safe to repeat."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultscope.operators import transfers as tra
from faultscope.plans import issue_registration as registration
from faultscope.sources.buckets import BucketTable
from faultscope.streaming import registration as stream
from workload import transfer_queries

FOLDER = "/root/testdata/sf0.001"
ISSUES = "message string, src_site string, dst_site string, type string, amount bigint, id bigint"


def batches(seed=3, n_batches=3):
    """Issues from a few templates with small and large changes, some of them again in later batches."""
    rng = random.Random(seed)
    bases = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(6, 18))) for _ in range(12)] + ["", "ab", "x"]
    out, place = [], 0
    for batch in range(n_batches):
        rows = []
        for _ in range(60):
            text = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 3, 9]) if text else 0):
                text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
            place += 1
            rows.append(("".join(text), f"S{rng.randrange(3)}", rng.choice(["D", None]), "transfer-error", rng.randrange(1, 9), place))
        out.append(rows)
    return out


def plain(table, columns):
    return sorted(map(tuple, table.select(*columns).collect()), key=str)


def test_like_the_batch_form(spark, tmp_path):
    store = stream.CategoryStore(spark, str(tmp_path), buckets=8)
    stored = spark.createDataFrame([], registration.ISSUE_SCHEMA)
    categories = spark.createDataFrame([], registration.CATEGORY_SCHEMA)
    keys = [*tra.ISSUE_KEY, "amount", "last_modified", "category"]
    for number, rows in enumerate(batches()):
        now = F.lit(datetime.datetime(2024, 1, 1 + number))
        incoming = spark.createDataFrame(rows, ISSUES)
        stored, categories = registration.register_issues(stored, categories, incoming, now)
        stored.write.parquet(f"{tmp_path}/plain/issues{number}")
        categories.write.parquet(f"{tmp_path}/plain/categories{number}")
        stored, categories = (spark.read.parquet(f"{tmp_path}/plain/{n}{number}") for n in ("issues", "categories"))
        # A batch that is tried again leaves what it left the first time.
        for _ in range(2 if number == 1 else 1):
            store.register(incoming, number, now)
        table, known = stream.registered(spark, str(tmp_path))
        assert plain(table, keys) == plain(stored, keys)
        assert plain(known, ["id", "regex", "amount"]) == plain(categories, ["id", "regex", "amount"])
    assert known.count() > 20


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "key string, n bigint", ["key"], 16)
    assert table.read().count() == 0
    first = spark.createDataFrame([(f"k{i}", i) for i in range(100)] + [(None, -1)], "key string, n bigint")
    table.write(first, table.touched(first), 0)
    change = spark.createDataFrame([("k5", 500)], "key string, n bigint")
    [bucket] = table.touched(change)
    rest = table.read([bucket], 1).filter("key != 'k5'").unionByName(change)
    table.write(rest, [bucket], 1)
    assert {r.key: r.n for r in table.read().collect()} == {**{f"k{i}": i for i in range(100)}, None: -1, "k5": 500}
    assert table.read(before=1).filter("n = 500").count() == 0
    versions = table.newest()
    assert versions.pop(bucket) == 1 and set(versions.values()) == {0}
    table.write(first.limit(0), [bucket], 2)
    assert bucket not in table.newest() and table.read().count() + table.read([bucket], 1).count() == 101


@pytest.mark.parametrize("edges", [("2024-01-16",), ("2024-01-07", "2024-01-13", "2024-01-19", "2024-01-25")])
def test_stream_in_batches(spark, monkeypatch, edges):
    """Two batches give what the batch form gives for them; five give the same amounts and issues in all."""
    columns = ["regex", "amount", "n_issues"]
    got = plain(transfer_queries.stream_register(spark, FOLDER, edges), columns)
    want = plain(transfer_queries.register_issues(spark, FOLDER), columns)
    if len(edges) == 1:
        assert got == want
    assert sum(r[2] for r in got) == sum(r[2] for r in want) and len(got) > 1
