"""Model results against what follows from their own predictions, and embeddings on planted words."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultscope.operators import clustering as clu
from faultscope.operators import cooccurrence as cooc
from faultscope.operators import messages as msg
from faultscope.plans import message_clustering as plan
from faultscope.plans.stages import clustering_pipeline
from workload import fixtures as fix
from workload import ml_queries

FOLDER = "/root/testdata/sf0.001"


def ranked(values, n=3):
    """(value, count) of the most frequent values, by name on ties."""
    return sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:n]


def test_message_analysis_sums_up_its_clusters(spark, monkeypatch):
    result, summary = ml_queries.analysed(spark, FOLDER)
    tokens = msg.abstract_messages(result.predictions, "tokens_cleaned", "abstract_message")
    found = {r.msg_id: (r.prediction, " ".join(r.abstract_message)) for r in tokens.select("msg_id", "prediction", "abstract_message").collect()}
    log = {r.msg_id: r for r in fix.messages(spark, FOLDER).select("msg_id", "src_hostname", "dst_hostname").collect()}
    members = {}
    for i in log:
        members.setdefault(found[i][0], []).append(i)
    assert len(members) >= 4
    monkeypatch.setattr(ml_queries, "analysed", lambda *_: (result, summary))
    rows = ml_queries.message_analysis(spark, FOLDER).collect()
    assert {r.prediction for r in rows} == set(members)
    for cluster, ids in members.items():
        mine = {r.rank_pattern: r for r in rows if r.prediction == cluster}
        patterns, sources, targets = (
            ranked(v) for v in ([found[i][1] for i in ids], [log[i].src_hostname for i in ids], [log[i].dst_hostname for i in ids])
        )
        assert sorted(mine) == list(range(1, max(map(len, (patterns, sources, targets))) + 1))
        for rank, r in mine.items():
            assert r.n_messages == len(ids) and r.unique_patterns == len({found[i][1] for i in ids})
            for name, count, share, best in (
                (r.pattern, r.n_patterns, r.msg_perc, patterns), (r.src_hostname, r.n_src, r.src_perc, sources), (r.dst_hostname, r.n_dst, r.dst_perc, targets),
            ):
                if rank <= len(best):
                    assert count == best[rank - 1][1] and share == pytest.approx(count / len(ids))
                    assert name.replace("\\", "") == best[rank - 1][0].replace("\\", "") or count == best[min(rank, len(best) - 1)][1]


def test_pipeline_puts_messages_to_the_nearest_center(spark, monkeypatch):
    model, log = ml_queries.fitted_pipeline(spark, FOLDER)
    rows = model.transform(log).select(ml_queries.SETTINGS.features_col).collect()
    points = np.array([r[0].toArray() for r in rows])
    centers = np.array(model.stages[-1].model.clusterCenters())
    lengths = np.linalg.norm(points, axis=1)
    known = lengths > 0
    near = (points[known] @ centers.T / np.linalg.norm(centers, axis=1)).argmax(axis=1)
    want = Counter(near.tolist()) + Counter({-1: int((~known).sum())})
    monkeypatch.setattr(ml_queries, "fitted_pipeline", lambda *_: (model, log))
    got = {r.prediction: r.n_messages for r in ml_queries.pipeline_clusters(spark, FOLDER).collect()}
    assert got == dict(want) and len(got) >= 4 and len(centers) == 4
    # The clusters explain more than one cluster of all would.
    units = points[known] / lengths[known][:, None]
    means = np.array([units[near == k].mean(axis=0) for k in range(4)])
    assert ((units - means[near]) ** 2).sum() < 0.7 * ((units - units.mean(axis=0)) ** 2).sum()


def test_embedding_brings_words_of_equal_use_together(spark):
    """Two words that stand in the same surroundings are closer than two of different ones."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        subject = i % 2
        around = [f"{'ab'[subject]}{rng.randrange(6)}" for _ in range(6)]
        rows.append((i, around[:3] + [rng.choice(["disk", "volume"] if subject else ["proxy", "token"])] + around[3:]))
    tokens = spark.createDataFrame(rows, "id bigint, stop_token_1 array<string>")
    model = clu.train_word2vec(tokens, embedding_size=12, window=4, min_count=2, partitions=1, max_iter=3)
    vectors = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    near = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    for word, other in (("disk", "volume"), ("proxy", "token")):
        assert near(word, other) > 0.3 + max(near(word, x) for x in ("disk", "volume", "proxy", "token") if x not in (word, other))


# --- vectors from counts


def plain_vectors(matrix, size):
    """Leading directions of a dense symmetric matrix, scaled by the root of their weights."""
    weights, turn = np.linalg.eigh(matrix)
    order = np.argsort(-np.abs(weights), kind="stable")[:size]
    return turn[:, order] * np.sqrt(np.abs(weights[order]))


def said(rng, days):
    """Messages on two subjects with words of their own, and some odd ones."""
    rows = []
    for _ in range(days * 200):
        subject = rng.randrange(3)
        rows.append([f"{'abc'[subject]}{rng.randrange(8)}" if rng.random() < 0.8 else f"x{rng.randrange(5)}" for _ in range(rng.randrange(9))])
    return rows + [None, [], ["alone"]]


@pytest.mark.parametrize("parts", [1, 7])
def test_vectors_of_added_counts_are_those_of_all_days(spark, parts):
    rng = random.Random(6)
    days = [said(rng, 2), said(rng, 1)]
    schema = "t array<string>"
    counts = [cooc.pair_counts(spark.createDataFrame([(t,) for t in day], schema).repartition(parts), "t", 2) for day in days]
    whole = cooc.pair_counts(spark.createDataFrame([(t,) for t in days[0] + days[1]], schema), "t", 2)
    added = cooc.add_counts(*counts)
    plain = Counter()
    for t in days[0] + days[1]:
        for i, word in enumerate(t or []):
            plain.update((word, t[j]) for j in range(max(0, i - 2), min(len(t), i + 3)) if j != i)
    assert {(r.word, r.context): r.n for r in added.collect()} == dict(plain) == {(r.word, r.context): r.n for r in whole.collect()}
    rated = cooc.shifted_ppmi(added, min_count=5, shift=1.2)
    values = {(r.word, r.context): r.value for r in rated.collect()}
    totals = Counter()
    for (w, _), n in plain.items():
        totals[w] += n
    often = {w for w, n in totals.items() if n >= 5}
    kept = {k: n for k, n in plain.items() if set(k) <= often}
    sums = Counter()
    for (w, _), n in kept.items():
        sums[w] += n
    want = {(a, b): np.log(n * sum(kept.values()) / (sums[a] * sums[b])) - np.log(1.2) for (a, b), n in kept.items()}
    assert values == {k: pytest.approx(v) for k, v in want.items() if v > 0}
    names = sorted({w for w, _ in values})
    dense = np.array([[values.get((a, b), 0.0) for b in names] for a in names])
    got = {r.word: r.vector for r in cooc.word_vectors(rated, 3, rounds=25).collect()}
    mine, plain_rows = np.array([got[w] for w in names]), plain_vectors(dense, 3)
    signs = np.sign((mine * plain_rows).sum(axis=0))
    assert mine * signs == pytest.approx(plain_rows, abs=1e-3)


def test_vectors_of_small_matrices(spark):
    """Fewer words than directions leave zeros; an empty matrix has no words."""
    schema = "word string, context string, value double"
    rows = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], schema)
    got = {r.word: np.abs(r.vector) for r in cooc.word_vectors(rows, 4, rounds=3).collect()}
    assert sorted(np.round(got["a"], 6).tolist()) == [0, 0, 1, 1] == sorted(np.round(got["b"], 6).tolist())
    assert cooc.word_vectors(spark.createDataFrame([], schema), 4).collect() == []


def test_pair_counts_of_both_directions(spark):
    rows = [["a", "b", "a", None, "c"], ["b", "b"], [], None, ["x"]]
    df = spark.createDataFrame([(r,) for r in rows], "tokens array<string>")
    for window in (1, 2, 9):
        want: dict = {}
        for row in rows:
            for i, w in enumerate(row or []):
                for j, c in enumerate(row):
                    if i != j and abs(i - j) <= window:
                        want[w, c] = want.get((w, c), 0) + 1
        assert {(r.word, r.context): r.n for r in cooc.pair_counts(df, "tokens", window).collect()} == want


def test_the_counts_are_added_up_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(cooc, "stored", lambda df, name, plain=cooc.stored: kept.append(name) or plain(df, name))
    counts = spark.createDataFrame([("a", "b", 9), ("b", "a", 9), ("a", "c", 1), ("c", "a", 1)], "word string, context string, n bigint")
    assert {(r.word, r.context) for r in cooc.shifted_ppmi(counts, min_count=5).collect()} == {("a", "b"), ("b", "a")}
    assert kept == ["pair-counts", "kept-pairs"]


def counted_log(spark, n=300):
    """Messages behind a function that counts its calls, some without any word that the embedding knows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        seen.add(1)
        return text

    rows = [(i, f"{'ab'[i % 2]}{i % 3} {'cd'[i % 2]}{i % 5} copy" if i % 10 else f"single{i}") for i in range(n)]
    log = spark.createDataFrame(rows, "msg_id long, text string").select("msg_id", said("text").alias("t__error_message"))
    return log, seen, n


SMALL = plan.ClusterSettings(embedding_size=4, window=3, min_count=5, k_values=[2, 3], search_max_iter=3, final_init_steps=2, final_max_iter=3)


def test_training_reads_the_messages_once_and_predictions_once(spark):
    log, seen, n = counted_log(spark)
    result = plan.cluster_messages(log, SMALL)
    assert seen.value == n
    rows = result.predictions.select("msg_id", "prediction").collect()
    assert seen.value == 2 * n
    assert len(rows) == n and all((r.prediction == clu.NO_CLUSTER) == (r.msg_id % 10 == 0) for r in rows)
    inferred = plan.infer_clusters(log, result.word2vec, result.best.model, SMALL).select("msg_id", "prediction").collect()
    assert sorted(inferred) == sorted(rows) and seen.value == 3 * n


def test_pipeline_reads_the_messages_once_per_stage_that_learns(spark):
    log, seen, n = counted_log(spark)
    model = clustering_pipeline(2, SMALL).fit(log)
    assert seen.value == 2 * n
    rows = model.transform(log).select("msg_id", "prediction").collect()
    assert seen.value == 3 * n
    assert len(rows) == n and all((r.prediction == clu.NO_CLUSTER) == (r.msg_id % 10 == 0) for r in rows)
