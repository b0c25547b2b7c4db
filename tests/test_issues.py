"""Issue finding, reduction and reports on hand-made and random data."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.operators import components, importance, issues, jobs, patterns, quality, report, transfers
from faultscope.plans import job_analysis

T0 = datetime.datetime(2024, 1, 1)


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def random_jobs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site, store, task = rng.randrange(4), rng.randrange(3), rng.randrange(5)
        bad = (site == 1 and rng.random() < 0.8) or (store == 2 and task == 0) or rng.random() < 0.02
        rows.append(
            (i, f"S{site}", f"D{store}", str(task), "failed" if bad else "finished", minutes(rng.randrange(600)),
             f"sig{site % 2}" if bad else "none", int(bad), int(not bad), 10.0 * bad)
        )
    return spark.createDataFrame(
        rows,
        "PANDAID bigint, COMPUTINGSITE string, DESTINATIONSE string, JEDITASKID string, JOBSTATUS string, "
        "ENDTIME timestamp, combinederrors string, ISFAILED int, ISSUCCESS int, LOSTWALLTIME double",
    )


FEATURES = ["COMPUTINGSITE", "DESTINATIONSE", "JEDITASKID"]


def test_cells_hold_the_slices(spark):
    frame = random_jobs(spark)
    windows = jobs.top_signatures(jobs.signature_frequency(frame), 2)
    cells = jobs.slice_cells(frame, windows, FEATURES)
    rows = jobs.signature_slice(frame, windows)
    sums = [F.sum("n_failed").alias("f"), F.sum("n_success").alias("s")]
    from_cells = {tuple(r) for r in cells.groupBy("slice", *FEATURES).agg(*sums).collect()}
    from_rows = rows.groupBy("slice", *FEATURES).agg(F.sum("ISFAILED").alias("f"), F.sum("ISSUCCESS").alias("s"))
    assert from_cells == {tuple(r) for r in from_rows.collect()}


def test_slice_margins_are_inclusive(spark):
    rows = [
        (1, "a", "failed", minutes(60)), (2, "a", "failed", minutes(120)), (3, "x", "finished", minutes(40)),
        (4, "x", "finished", minutes(39)), (5, "x", "finished", minutes(140)), (6, "x", "finished", minutes(141)),
        (7, "b", "failed", minutes(90)), (8, "a", "finished", minutes(130)),
    ]
    frame = spark.createDataFrame(rows, "PANDAID bigint, combinederrors string, JOBSTATUS string, ENDTIME timestamp")
    windows = spark.createDataFrame([("a", minutes(60), minutes(120))], "combinederrors string, window_start timestamp, window_end timestamp")
    got = jobs.signature_slice(frame, windows).select("PANDAID")
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 5, 8]


def greedy(values, shared):
    """Pairs of numbered values, walked in order."""
    taken, sets = set(), []
    for i in values:
        if i in taken:
            continue
        found = [j for j in values if j > i and j not in taken and (i, j) in shared]
        for j in found:
            taken.add(j)
            sets.append({i, j})
        if not found and (i, i) in shared:
            sets.append({i})
    return sets


@pytest.mark.parametrize("seed", range(5))
def test_feature_sets_follow_the_walk(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    shared = {(i, j) for i in range(n) for j in range(i, n) if rng.random() < (0.9 if i == j else 0.3)}
    important = spark.createDataFrame(
        [("s", f"F{i}", f"v{i}", 10.0, i) for i in range(n)], "slice string, feature string, value string, importance double, number int"
    )
    pairs = [("s", i, j, 1 if (i, j) in shared else 0) for i in range(n) for j in range(i, n)]
    counts = spark.createDataFrame(pairs, "slice string, first int, second int, n_failed bigint")
    rows = issues.feature_sets(important, counts).orderBy("number").collect()
    got = [{int(k[1:]) for k in r["features"]} for r in rows]
    assert got == (greedy(range(n), shared) if shared else [])


def test_planted_cause_is_found(spark):
    frame = random_jobs(spark).withColumns({f: F.lit("PILOT") for f in ("PILOTERRORDIAG",)})
    settings = job_analysis.JobSettings(features=FEATURES, diag_fields=["PILOTERRORDIAG"], code_fields=[])
    found = job_analysis.find_issues(frame, settings).collect()
    assert any(r["features"].get("COMPUTINGSITE") == "S1" for r in found if r["signature"] == "sig1")
    for r in found:
        assert r["purity"] == pytest.approx(r["n_failed"] / (r["n_failed"] + r["n_success"]))


def test_boosted_importance_recovers_the_planted_value(spark):
    rows = [(f"S{i % 4}", f"D{i % 3}", int(i % 4 == 2)) for i in range(240)]
    frame = spark.createDataFrame(rows, "COMPUTINGSITE string, DESTINATIONSE string, ISFAILED int")
    scores = importance.boosted_importance(frame, ["COMPUTINGSITE", "DESTINATIONSE"], iterations=5, step_size=0.1)
    top = scores.orderBy(F.desc("importance")).first()
    assert (top["feature"], top["value"]) == ("COMPUTINGSITE", "S2")


def plain_boosting(rows, features, rounds, rate, l2=importance.LEAF_WEIGHT):
    """Boosted stumps, split by split, over cells (values, t_failed, t_success, v_failed, v_success): importances and rounds kept."""
    x = [[r[f] for f in features] for r in rows]
    failed, n = (np.array(c, float) for c in ([r["t_failed"] for r in rows], [r["t_failed"] + r["t_success"] for r in rows]))
    held = np.array([(r["v_failed"], r["v_success"]) for r in rows], float)
    score, losses, splits = np.zeros(len(rows)), [], []
    for number in range(rounds + 1):
        losses.append((held[:, 0] * np.logaddexp(0, -score) + held[:, 1] * np.logaddexp(0, score)).sum())
        p = 1 / (1 + np.exp(-score))
        g, h = failed - n * p, n * p * (1 - p)
        best = None
        for k in range(len(features)):
            for value in sorted({v[k] for v in x}):
                inside = np.array([v[k] == value for v in x])
                if 0 < n[inside].sum() < n.sum():
                    gl, hl = g[inside].sum(), h[inside].sum()
                    gr, hr = g.sum() - gl, h.sum() - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                    rank = (-round(gain, importance.DECIMALS), k, value)
                    if best is None or rank < best[0]:
                        best = rank, gain, inside, rate * gl / (hl + l2), rate * gr / (hr + l2)
        if number == rounds or best is None or best[1] <= 0:
            break
        (_, k, value), _, inside, a, b = best
        score += np.where(inside, a, b)
        splits.append((features[k], value, (a - b) ** 2 * n[inside].sum() * n[~inside].sum() / n.sum()))
    kept = int(np.argmin(losses)) if held.sum() else len(splits)
    weights = {}
    for f, v, w in splits[:kept]:
        weights[f, v] = weights.get((f, v), 0.0) + w
    total = sum(weights.values())
    return {k: 100 * w / total for k, w in weights.items() if total}, kept


def test_boosting_is_that_of_single_rows(spark):
    """Several slices at once, each like a plain version; slices of one kind have no rows."""
    rng = random.Random(8)
    rows = []
    for name, cause in (("a", ("A", "1")), ("b", ("B", "2")), ("noise", None), ("few", ("A", "0"))):
        for _ in range(12 if name == "few" else 80):
            values = dict(A=str(rng.randrange(4)), B=str(rng.randrange(5)), C=rng.choice(["x", "Not specified"]))
            bad = rng.random() < (0.8 if cause and values[cause[0]] == cause[1] else 0.2)
            rows.append((name, *values.values(), rng.randrange(30) * bad, rng.randrange(30) * (not bad)))
    rows += [("only", "1", "1", "x", 5, 0), ("only", "2", "1", "x", 7, 0)]
    features = ["A", "B", "C"]
    cells = spark.createDataFrame(rows, "slice string, A string, B string, C string, n_failed bigint, n_success bigint")
    divided = importance.divided_cells(cells, features, 0.9).collect()
    assert 0.05 < sum(r.v_failed + r.v_success for r in divided) / sum(r[-1] + r[-2] for r in rows) < 0.15
    for rounds, rate in ((12, 0.3), (3, 0.01)):
        got = importance.boost_cells(cells, features, rounds, rate).collect()
        assert "only" not in {r.slice for r in got}
        for name in ("a", "b", "noise", "few"):
            want, kept = plain_boosting([r for r in divided if r.slice == name], features, rounds, rate)
            mine = [r for r in got if r.slice == name]
            assert {(r.feature, r.value): pytest.approx(r.importance) for r in mine} == want
            assert {r.rounds for r in mine} == ({kept} if want else set())
    top = max((r for r in got if r.slice == "a"), key=lambda r: r.importance)
    assert (top.feature, top.value) == ("A", "1")
    assert importance.boost_cells(cells.limit(0), features, 3).collect() == []


def issue_frame(spark, maps, extra=""):
    rows = [(i, m, minutes(0), minutes(600)) for i, m in maps.items()]
    return spark.createDataFrame(rows, "issue_id bigint, features map<string,string>, window_start timestamp, window_end timestamp")


def similar(a, b):
    common = len(a.items() & b.items())
    return common == min(len(a), len(b)) or (common > 0 and common + 1 in (len(a), len(b)))


def groups_by_hand(maps):
    label = {i: i for i in maps}
    changed = True
    while changed:
        changed = False
        for i in maps:
            for j in maps:
                low = min(label[i], label[j])
                if similar(maps[i], maps[j]) and (label[i] > low or label[j] > low):
                    label[i] = label[j] = low
                    changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_similar_groups(spark, seed):
    rng = random.Random(seed)
    maps = {
        i: {k: str(rng.randrange(6)) for k in rng.sample("ABCDE", rng.randrange(1, 5))} for i in range(40)
    }
    got = {r["issue_id"]: r["group_id"] for r in issues.similar_groups(issue_frame(spark, maps)).collect()}
    assert got == groups_by_hand(maps)


def test_features_similar(spark):
    cases = [({"a": "1"}, {"a": "1", "b": "2"}), ({"a": "1"}, {"b": "1"}), ({"a": "1", "b": "2", "c": "3"}, {"a": "1", "d": "4"}),
             ({"a": "1", "b": "2", "c": "3"}, {"a": "1", "d": "4", "e": "5"})]
    df = spark.createDataFrame(cases, "l map<string,string>, r map<string,string>")
    got = [r[0] for r in df.select(issues.features_similar(F.col("l"), F.col("r"))).collect()]
    assert got == [similar(a, b) for a, b in cases]


def test_long_chain_and_hot_hub_are_connected(spark):
    chain = [(i, f"h{i}") for i in range(60)] + [(i + 1, f"h{i}") for i in range(60)]
    hub = [(1000 + i, "hot") for i in range(500)]
    links = spark.createDataFrame(chain + hub, "node bigint, hub string")
    got = {r["node"]: r["group"] for r in components.connected_groups(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(500))


def test_overlap_and_drop(spark):
    frame = random_jobs(spark)
    maps = {1: {"COMPUTINGSITE": "S1"}, 2: {"COMPUTINGSITE": "S1", "DESTINATIONSE": "D1"}, 3: {"DESTINATIONSE": "D2"}}
    table = issue_frame(spark, maps)
    failed = {}
    for r in frame.filter("ISFAILED = 1").collect():
        for i, m in maps.items():
            if all(r[k] == v for k, v in m.items()):
                failed.setdefault(i, set()).add(r["PANDAID"])
    want = {
        (i, j, len(failed[i] & failed[j])) for i in failed for j in failed
        if i != j and len(failed[i] & failed[j]) / len(failed[i]) > 0.3
    }
    overlap = issues.failed_overlap(frame, table, FEATURES)
    assert {(r["issue_id"], r["other_id"], r["n_shared"]) for r in overlap.collect()} == want
    kept = {r["issue_id"] for r in issues.drop_overlapping(table, overlap).collect()}
    assert 2 not in kept and 1 in kept


def test_ticks_keep_the_totals_and_fill_gaps(spark):
    frame = random_jobs(spark, 60)
    ticks = issues.dense_ticks(frame.filter("ISFAILED = 1"), ["COMPUTINGSITE"])
    failed = frame.filter("ISFAILED = 1").groupBy("COMPUTINGSITE").count()
    assert {tuple(r) for r in ticks.groupBy("COMPUTINGSITE").agg(F.sum("nfailed_jobs")).collect()} == {tuple(r) for r in failed.collect()}
    times = sorted(r["tick_time"] for r in ticks.filter("COMPUTINGSITE = 'S1'").collect())
    assert all(b - a == datetime.timedelta(minutes=15) for a, b in zip(times, times[1:]))


def test_trend_bins(spark):
    base = 1_704_067_200_000
    rows = [(1, base + 60_000 * m) for m in (0, 0, 1, 144, 288)] + [(2, base), (2, 0)]
    df = spark.createDataFrame(rows, "prediction int, t bigint")
    got = {(r["prediction"], r["bin"]): r["n_messages"] for r in patterns.cluster_trend(df, "t").collect()}
    assert {k: v for k, v in got.items() if v} == {(1, 1): 3, (1, 72): 1, (1, 144): 1, (2, 1): 1}
    assert len(got) == 288


def test_full_rank_equals_the_window_for_a_hot_cluster(spark):
    rows = [(0 if i % 3 else i % 5, f"v{i % 97}") for i in range(3000)]
    df = spark.createDataFrame(rows, "prediction int, src string")
    everything = patterns.top_patterns(df, "prediction", "src", "n_src")
    limited = patterns.top_patterns(df, "prediction", "src", "n_src", 10**6)
    assert {tuple(r) for r in everything.collect()} == {tuple(r) for r in limited.collect()}


def test_report_prefers_the_newest_issue_per_tick(spark):
    info = spark.createDataFrame(
        [(1, T0, minutes(60), 0, "old"), (2, T0, minutes(60), 0, "new"), (3, T0, minutes(60), 0, "zero")],
        "issue_id bigint, observation_started timestamp, observation_finished timestamp, payload_type int, err_messages string",
    )
    meta = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "A", "y")], "issue_id bigint, key string, value string")
    ticks = spark.createDataFrame(
        [(1, T0, 5.0, 1), (1, minutes(15), 7.0, 2), (2, minutes(15), 1.0, 4), (3, T0, 9.0, 0)],
        "issue_id bigint, tick_time timestamp, walltime_loss double, nfailed_jobs bigint",
    )
    from faultscope.plans.issue_report import issue_report

    top, histogram = issue_report(info, meta, ticks, T0, minutes(60))
    rows = top.collect()
    assert [(r["name"], r["issue_id"], r["err_messages"], r["walltime_loss"], r["nfailed_jobs"]) for r in rows] == [("N_0", 2, "old", 6.0, 5)]
    assert sorted((r["walltime_loss"], r["nfailed_jobs"]) for r in histogram.collect()) == [(1.0, 4), (5.0, 1)]
    assert report.top_issues(top.drop("name", "place"), metric="other").count() == 0


def test_upsert_keeps_amounts(spark):
    stored = spark.createDataFrame([("m", "a", "b", "t", 5, T0)], "message string, src_site string, dst_site string, type string, amount bigint, last_modified timestamp")
    new = spark.createDataFrame([("m", "a", "b", "t", 7), ("n", "a", "b", "t", 2), ("n", "a", "b", "t", 1)], "message string, src_site string, dst_site string, type string, amount bigint")
    got = {(r["message"], r["amount"], r["last_modified"]) for r in transfers.upsert_issues(stored, new, F.lit(minutes(5))).collect()}
    assert got == {("m", 5, minutes(5)), ("n", 3, minutes(5))}


def test_search_pages_and_orders(spark):
    df = spark.range(250).selectExpr("id", "concat('Msg ', id) AS message", "id % 2 AS category", "'a' AS src_site", "'b' AS dst_site", "id AS last_modified")
    assert [r["id"] for r in transfers.search_issues(df, message="mSG", order_by="-id", page=3).collect()] == list(range(49, -1, -1))
    assert transfers.search_issues(df, categories="1", page=None).count() == 125
    with pytest.raises(ValueError):
        transfers.search_issues(df, order_by="message")


def test_violations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, ref int")
    assert [tuple(r) for r in quality.key_violations(df, ["k"]).collect()] == [("a", 2)]
    parent = spark.createDataFrame([(2,)], "id int")
    assert quality.orphans(df, "ref", parent, "id").count() == 2


def test_similar_groups_of_many_features(spark):
    wide = {f"F{i}": str(i) for i in range(12)}
    maps = {
        0: wide,
        1: {k: v for k, v in wide.items() if k != "F3"},
        2: {**wide, "F5": "other"},
        3: {"F7": "7"},
        4: {"F7": "8"},
        5: {**{k: v for k, v in wide.items() if k != "F1"}, "F2": "x"},
    }
    got = {r["issue_id"]: r["group_id"] for r in issues.similar_groups(issue_frame(spark, maps)).collect()}
    assert got == groups_by_hand(maps)


def test_signatures_of_colliding_short_hashes(spark):
    """Two texts whose hashes begin with the same six digits keep their own signature."""
    import hashlib

    from faultscope.functions import text

    seen, pair = {}, None
    for i in range(100_000):
        digits = hashlib.sha1(f"error {i}".encode()).hexdigest()[:6]
        if digits in seen:
            pair = (seen[digits], f"error {i}")
            break
        seen[digits] = f"error {i}"
    df = spark.createDataFrame([(t,) for t in pair], "t string")
    assert df.select(text.error_signature([F.col("t")], 6)).distinct().count() == 1
    assert df.select(text.error_signature([F.col("t")])).distinct().count() == 2


def test_constraints_of_given_tables_only(spark):
    from faultscope.operators import quality

    action = spark.createDataFrame([(1, "a"), (2, "a")], "id int, action string")
    solution = spark.createDataFrame([(1, 1, "src_site"), (2, 9, "elsewhere")], "id int, solution int, affected_site string")
    got = {tuple(r)[:3]: r[3] for r in quality.check_constraints({"action": action, "solution": solution}).collect()}
    assert got == {("key", "action", "action"): 1, ("choice", "solution", "affected_site"): 1, ("reference", "solution", "solution"): 1}
    with pytest.raises(ValueError):
        quality.check_constraints({"other": action})
