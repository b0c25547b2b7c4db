"""Clusters that follow a stream, and the mended edges of clustering, report and job cycle."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.operators import clustering as clu
from faultscope.operators import report
from faultscope.plans import job_analysis
from faultscope.streaming import clustering as stream
from workload import ml_queries

FOLDER = "/root/testdata/sf0.001"


def far(x, c):
    return 1 - (x @ c) / (np.linalg.norm(x) * np.linalg.norm(c))


def plain_follow(batches, centers, settings):
    """The same loop, vector by vector: {cluster: (centroid, size)} and the cluster of each id."""
    given = {}
    for batch in batches:
        for _ in range(settings.new_clusters):
            rated = [(min(far(x, c) for c, _ in centers.values()) if centers else 0.0, i, x) for i, x in batch if x.any()]
            rated = [r for r in rated if r[0] > settings.threshold or not centers]
            if not rated:
                break
            _, _, seed = min(rated, key=lambda r: (-r[0], r[1]))
            centers[max(centers, default=-1) + 1] = (seed, 0.0)
        moved = {}
        for i, x in batch:
            best = min(((far(x, c), k) for k, (c, _) in centers.items()), default=(9, -1)) if x.any() else (9, -1)
            given[i] = best[1] if best[0] <= settings.threshold else -1
            if given[i] >= 0:
                moved.setdefault(given[i], []).append(x)
        for k, (c, size) in centers.items():
            weight = size * settings.decay
            own = moved.get(k, [])
            centers[k] = ((c * weight + np.sum(own, axis=0)) / (weight + len(own)) if own else c, weight + len(own))
    return centers, given


def test_stream_follows_like_a_plain_loop(spark):
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()]
    start = {k: (np.mean([x for _, x, y in rows if y == k], axis=0), float(sum(y == k for *_, y in rows))) for k in {y for *_, y in rows} if k < 5}
    batches = [[(i, x) for i, x, _ in rows if i % 3 == k] for k in range(3)]
    want, given = plain_follow(batches, dict(sorted(start.items())), ml_queries.FOLLOW)
    got = ml_queries.stream_clusters(spark, FOLDER).collect()
    assert {r.cluster for r in got} == set(want) and len(want) > len(start)
    for r in got:
        assert r.x == pytest.approx(want[r.cluster][0][r.dim], abs=2e-4) and r.size == pytest.approx(want[r.cluster][1], abs=1e-3)
        assert (r.n_given or 0) == sum(g == r.cluster for g in given.values())


def test_follow_from_nothing_with_zero_vectors_and_retries(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(4)[i % 3] + rng.normal(0, 0.05, 4)).tolist()) for i in range(60)] + [(90, [0.0] * 4), (91, [0.0] * 4)]
    settings = stream.FollowSettings(threshold=0.3, new_clusters=3, decay=0.5)
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>")
    store = stream.CentroidStore(spark, str(tmp_path))
    assert store.read().count() == 0
    want, given = plain_follow([[(i, np.array(x)) for i, x in rows]] * 2, {}, settings)
    for number in (0, 1, 1):
        out, after = stream.follow(vectors, store.read(number), "id", "v", settings)
        assert {r.id: r.cluster for r in out.collect()} == given
        store.write(after, number)
    got = {r.cluster: r for r in store.read().collect()}
    assert set(got) == set(want) == {0, 1, 2}
    for k, (c, size) in want.items():
        assert got[k].centroid == pytest.approx(c.tolist()) and got[k].size == pytest.approx(size)
    assert store.read(1).agg(F.sum("size")).first()[0] == 60
    empty = stream.follow(vectors.limit(0), store.read(), "id", "v", settings)
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_nearest_of_no_centroids(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<double>")
    none = spark.createDataFrame([], "cluster int, centroid array<double>")
    assert [(r.cluster, r.distance) for r in clu.nearest_centroid(vectors, none, "v").collect()] == [(-1, None)]
    monkeypatch.setattr(clu, "MOST_NUMBERS", 1)
    with pytest.raises(ValueError):
        clu.nearest_centroid(vectors, spark.createDataFrame([(0, [1.0, 0.0])], none.schema), "v")


def test_features_with_two_values_of_a_key(spark):
    issues = spark.createDataFrame([(1,), (2,)], "issue_id bigint")
    meta = spark.createDataFrame([(1, "SITE", "a"), (1, "SITE", "b"), (1, "SITE", "b"), (1, "X", "c")], "issue_id bigint, key string, value string")
    assert [(r.issue_id, r.features) for r in report.issue_features(issues, meta).collect()] == [(1, {"SITE": "b", "X": "c"})]


def test_cycle_takes_jobs_that_run_over_its_end(spark, monkeypatch, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "failed", day(3), day(9)), (2, "finished", day(1), day(4)), (3, "failed", day(9), day(10)), (4, "failed", day(1), day(2)),
            (5, "failed", None, day(4)), (6, "cancelled", day(3), day(4)), (7, "failed", day(3), None)]
    jobs = spark.createDataFrame(rows, "PANDAID bigint, JOBSTATUS string, STARTTIME timestamp, ENDTIME timestamp")
    taken = []

    def analysed(window, *_):
        taken.extend(sorted(r.PANDAID for r in window.collect()))
        raise RuntimeError("seen")

    monkeypatch.setattr(job_analysis, "analyse_jobs", analysed)
    with pytest.raises(RuntimeError):
        job_analysis.run_job_cycle(jobs, str(tmp_path), day(3), day(8))
    assert taken == [1, 2, 5]
