"""Deleting from the issue store, days that are over, the message index with its pages, and the shared search for K."""

import datetime
import glob
import os
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from faultscope.operators import clustering as clu
from faultscope.operators import k_search, quality, search
from faultscope.operators.transfers import search_issues
from faultscope.session import scratch_path
from faultscope.sources import stores
from faultscope.streaming.days import DayTable

DAY = datetime.date(2024, 1, 1)


def files_of(path, part=""):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/{part}*/*.parquet", recursive=True)}


# -- retention ------------------------------------------------------------------------------


@pytest.fixture
def issue_tree(spark):
    """Sessions 1 and 2 begin on days 1 and 2, session 3 has issues of both."""
    path = scratch_path(spark, "tree")
    rows = [(10, 1, 1), (11, 1, 1), (20, 2, 2), (30, 3, 1), (31, 3, 2), (32, 3, None)]
    time = F.when(F.col("d").isNotNull(), F.make_timestamp(F.lit(2024), F.lit(1), F.col("d"), F.lit(12), F.lit(0), F.lit(0)))
    issues = spark.createDataFrame(rows, "issue_id bigint, session_id bigint, d int").withColumn("observation_started", time).drop("d")
    children = issues.select("issue_id", "session_id")
    meta = children.filter("issue_id <> 20").selectExpr("issue_id", "'SITE' AS key", "'S' AS value", "session_id")
    ticks = children.selectExpr("issue_id", "explode(array(1, 2)) AS tick", "session_id")
    stores.write_tables({"issues": issues, "issue_meta": meta, "issue_ticks": ticks}, path)
    return path


def left(spark, path):
    return {name: sorted(r["issue_id"] for r in t.collect()) for name, t in stores.read_issue_store(spark, path).items()}


def test_deleted_issues_take_their_children_along(spark, issue_tree):
    before = files_of(issue_tree, "session_id=1")
    stores.delete_issues(spark, issue_tree, datetime.datetime(2024, 1, 1, 12))
    want = {"issues": [10, 11, 30, 32], "issue_meta": [10, 11, 30, 32], "issue_ticks": [10, 10, 11, 11, 30, 30, 32, 32]}
    assert left(spark, issue_tree) == want
    assert before and files_of(issue_tree, "session_id=1") == before
    assert not glob.glob(f"{issue_tree}/*/session_id=2")
    everything = files_of(issue_tree)
    stores.delete_issues(spark, issue_tree, datetime.datetime(2024, 1, 1, 12))
    assert files_of(issue_tree) == everything
    tables = stores.read_issue_store(spark, issue_tree)
    given = {"workflow_issue": tables["issues"], "workflow_issue_metadata": tables["issue_meta"], "workflow_issue_ticks": tables["issue_ticks"]}
    found = quality.check_constraints(given).collect()
    assert len(found) == 2 and {r["n_violations"] for r in found} == {0}


def test_a_run_that_was_cut_off_is_repeated(spark, issue_tree):
    # As if it had ended after the ticks.
    tables = stores.read_issue_store(spark, issue_tree)
    late = tables["issues"].filter("observation_started >= '2024-01-02'").select("issue_id", "session_id")
    stores._delete_rows(tables["issue_ticks"], f"{issue_tree}/issue_ticks", late)
    assert left(spark, issue_tree)["issues"] == [10, 11, 20, 30, 31, 32]
    stores.delete_issues(spark, issue_tree, datetime.datetime(2024, 1, 1, 12))
    assert left(spark, issue_tree)["issue_meta"] == [10, 11, 30, 32]


def test_a_store_may_lose_all_its_issues(spark, issue_tree):
    without = stores.read_issue_store(spark, issue_tree)["issues"].filter("observation_started IS NULL")
    stores._delete_rows(stores.read_issue_store(spark, issue_tree)["issues"], f"{issue_tree}/issues", without.select("issue_id", "session_id"))
    stores.delete_issues(spark, issue_tree, datetime.datetime(2023, 1, 1))
    assert left(spark, issue_tree)["issues"] == []
    assert "observation_started" in stores.read_issue_store(spark, issue_tree)["issues"].columns


# -- days -----------------------------------------------------------------------------------


def ticks(spark, rows):
    made = [(n, datetime.datetime(2024, 1, day, hour)) for n, day, hour in rows]
    return spark.createDataFrame(made, "n int, tick_time timestamp")


def test_days_are_merged_once_over_and_read_alone(spark):
    path = scratch_path(spark, "days")
    table = DayTable(spark, path, "n int, tick_time timestamp", "tick_time")
    assert table.read().collect() == [] and table.compact() == []
    table.write(ticks(spark, [(1, 1, 5), (2, 1, 6)]), 0)
    table.write(ticks(spark, [(3, 1, 7), (4, 2, 1)]), 1)
    # A batch that is tried again replaces its rows.
    table.write(ticks(spark, [(3, 1, 7), (4, 2, 1)]), 1)
    numbers = lambda *days: sorted(r["n"] for r in table.read(*days).collect())
    assert numbers() == [1, 2, 3, 4]
    assert table.compact() == [DAY]
    assert numbers() == [1, 2, 3, 4] and not os.path.exists(f"{path}/open/day=2024-01-01")
    assert len(glob.glob(f"{path}/closed/day=2024-01-01/*.parquet")) == 1
    # The last batch again, after its day was merged, and the next run of the merge.
    table.write(ticks(spark, [(3, 1, 7), (4, 2, 1)]), 1)
    assert numbers() == [1, 2, 3, 4]
    assert table.compact() == [] and not os.path.exists(f"{path}/open/day=2024-01-01")
    table.write(ticks(spark, [(5, 3, 0)]), 2)
    assert table.compact() == [DAY + datetime.timedelta(1)] and numbers() == [1, 2, 3, 4, 5]
    # Files of other days aren't opened.
    for broken in glob.glob(f"{path}/closed/day=2024-01-01/*.parquet"):
        open(broken, "w").write("no table")
    assert numbers(DAY + datetime.timedelta(1)) == [4, 5]
    assert numbers(DAY + datetime.timedelta(1), DAY + datetime.timedelta(1)) == [4]


# -- search ---------------------------------------------------------------------------------


def issues_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, message string, category int, src_site string")


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbB ç") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "ab", "aaaa", "AAAA"]
    rows = [(n, t, n % 3, "S") for n, t in enumerate(texts + texts[:40])]
    issues = issues_of(spark, rows)
    index = search.IssueIndex(spark, scratch_path(spark, "index"), buckets=4)
    index.build(issues)
    for part in ["", "a", "Ab", "aab", "AAA", "aaaa", "b ç", "ab ba", "aaaaaaaaaaaaaaaaaa", "xyz", "%"]:
        want = sorted(r["id"] for r in search_issues(issues, message=part, page=None).collect())
        assert sorted(r["id"] for r in index.search(message=part).collect()) == want, part
    assert [r["id"] for r in index.search(issue_id=7).collect()] == [7]
    assert index.search(categories="0,2").count() == sum(r[2] != 1 for r in rows)
    assert index.search().columns == issues.columns
    index.build(issues.limit(0))
    assert index.search(message="abc").collect() == [] == index.search(message="a").collect()


def test_index_reads_the_buckets_of_its_grams(spark):
    index = search.IssueIndex(spark, scratch_path(spark, "index"), buckets=8)
    index.build(issues_of(spark, [(n, f"message {n}", 0, "S") for n in range(20)]))
    plan = index._of_grams("grams", ["mes"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("order", ["id", "-id", "src_site", "-src_site"])
def test_pages_follow_each_other(spark, order):
    rows = [(n, "m", 0, [None, "A", "B", "B", "C"][n * 7 % 5]) for n in range(53)]
    issues = issues_of(spark, rows)
    want = [r["id"] for r in search_issues(issues, order_by=order, page=None).collect()]
    bounds = search.page_bounds(issues, order, 10)
    got = [[r["id"] for r in search.page(issues, bounds, n, order, 10).collect()] for n in range(1, 8)]
    assert got == [want[at : at + 10] for at in range(0, 70, 10)]
    assert "Offset" not in search.page(issues, bounds, 3, order, 10)._jdf.queryExecution().optimizedPlan().toString()
    column = order.lstrip("-")
    chained, rest = got[0], search.page(issues, bounds, 1, order, 10).collect()
    while rest:
        rest = search.next_page(issues, rest[-1][column], rest[-1]["id"], order, 10).collect()
        chained = chained + [r["id"] for r in rest]
    assert chained == want


# -- search for K ---------------------------------------------------------------------------


def clouds(spark, seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ((4, 0, 0), (0, 4, 0), (0, 0, 4), (3, 3, 0))])
    x = np.concatenate([x, x[:30], x[:30]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
    return x, df.select(array_to_vector("v").alias("features"))


def plain_lloyd(x, centers, distance, tol, max_iter):
    def far(c):
        return 1 - x @ c.T if distance == "cosine" else ((x[:, None] - c[None]) ** 2).sum(axis=2)

    steps = 0
    while steps < max_iter:
        near = far(centers).argmin(axis=1)
        moved = np.array([x[near == i].mean(axis=0) if (near == i).any() else centers[i] for i in range(len(centers))])
        if distance == "cosine":
            moved /= np.linalg.norm(moved, axis=1, keepdims=True)
            shift = 1 - (moved * centers).sum(axis=1)
        else:
            shift = np.linalg.norm(moved - centers, axis=1)
        centers, steps = moved, steps + 1
        if shift.max() <= tol:
            break
    return centers, far(centers).min(axis=1).sum(), far(centers).argmin(axis=1), steps


@pytest.mark.parametrize("distance", ["cosine", "euclidean"])
def test_every_model_of_the_search_is_that_of_a_plain_run(spark, distance):
    x, features = clouds(spark)
    starts = k_search.start_centers(k_search.weighted_vectors(features), 6, distance)
    models = k_search.search_shared(features, [2, 4, 6], distance=distance)
    x = k_search.ready(x, distance)
    for model in models:
        centers, cost, near, steps = plain_lloyd(x, starts[: model.k], distance, 1e-4, 30)
        assert np.allclose(model.centers, centers) and model.steps == steps
        assert model.wsse == pytest.approx(cost)
        rows = [(v.tolist(), int(c)) for v, c in zip(x, near)]
        given = spark.createDataFrame(rows, "v array<double>, prediction int").select(array_to_vector("v").alias("features"), "prediction")
        assert model.silhouette == pytest.approx(clu.silhouette(given, distance))


def test_the_query_gives_plain_runs(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    x = np.array([r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("embedding").collect()], float)
    features = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(array_to_vector("v").alias("features"))
    starts = k_search.start_centers(k_search.weighted_vectors(features), 8)
    rows = {r["k"]: r for r in entry.queries()["shared_search"](spark, folder).collect()}
    assert sorted(rows) == [2, 3, 5, 8]
    for k, r in rows.items():
        _, cost, _, steps = plain_lloyd(k_search.ready(x, "cosine"), starts[:k], "cosine", 1e-4, 10)
        assert r["steps"] == steps and r["wsse"] == pytest.approx(cost, abs=1e-5)


def test_models_share_their_scans(spark):
    _, features = clouds(spark)

    def jobs(k_values):
        group = f"search-{k_values}"
        spark.sparkContext.setJobGroup(group, group)
        steps = max(m.steps for m in k_search.search_shared(features, k_values, tol=-1.0, max_iter=4))
        assert steps == 4
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs([2, 3, 4, 5, 6]) == jobs([6])


def test_search_with_few_vectors(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>").select(array_to_vector("v").alias("features"))
    models = k_search.search_shared(same, [2, 3])
    assert [(m.k, len(m.centers), m.silhouette) for m in models] == [(2, 1, None), (3, 1, None)]
    assert all(m.wsse == pytest.approx(0) for m in models)
    with pytest.raises(ValueError, match="no vectors"):
        k_search.search_shared(same.limit(0), [2])


def test_grams_are_all_three_characters_in_a_row(spark):
    texts = ["", "ab", "abc", "abcabcd", "a\nb\r\n c", "ä\U0001f642\U0001f643b\U0001f642\U0001f643b", "\x00\x85 �\U0010ffff"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search._grams(F.col("t")).alias("grams")).collect()
    for t, grams in got:
        assert grams == (list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) if len(t) > 2 else None)


def test_common_grams_are_counted_but_not_listed(spark, monkeypatch):
    """A gram of all texts has no list of them, and parts made of such grams are still found."""
    monkeypatch.setattr(search, "MANY", 2)
    issues = spark.createDataFrame([(i, f"copy of file {i * 7919 % 100000:05d} failed") for i in range(64)], "id bigint, message string")
    index = search.IssueIndex(spark, scratch_path(spark, "index"), buckets=4)
    index.build(issues)
    listed = {r[0] for r in index._table("grams").select("gram").distinct().collect()}
    assert "cop" not in listed and "ile" not in listed and listed
    for part in ("COPY of", "file 0", "5838 f", "of file 07919 failed", "le", "nothing"):
        want = {i for i in range(64) if part.lower() in f"copy of file {i * 7919 % 100000:05d} failed"}
        assert {r.id for r in index.search(message=part).collect()} == want
