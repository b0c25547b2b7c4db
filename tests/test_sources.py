"""Files, snapshots, streams, models."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from faultscope.operators import clustering as clu
from faultscope.plans import message_clustering as plan
from faultscope.session import scratch_path, shared_folder
from faultscope.sources import files, stores
from faultscope.streaming import windows as stw

T0 = datetime.datetime(2024, 1, 1)


def test_day_paths():
    day = datetime.date(2024, 2, 29)
    assert files.day_paths("/base/", day, datetime.date(2024, 3, 1), datetime.date(2024, 3, 1)) == [
        "/base/2024/02/29/",
        "/base/2024/03/01.tmp/",
    ]


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_snapshot_falls_back_and_reports_the_first_failure(spark):
    path = scratch_path(spark, "snap")

    def broken():
        return spark.read.parquet("/nowhere/at/all")

    with pytest.raises(Exception, match="nowhere"):
        files.load_with_snapshot(spark, broken, lambda d: d, path)
    files.load_with_snapshot(spark, lambda: spark.range(3), lambda d: d, path)
    files.load_with_snapshot(spark, lambda: spark.range(5), lambda d: d, path)
    assert files.load_with_snapshot(spark, broken, lambda d: d, path).count() == 5

    def fails_in_task(df):
        return df.select(F.raise_error(F.lit("bad row")).cast("bigint").alias("id"))

    assert files.load_with_snapshot(spark, lambda: spark.range(1), fails_in_task, path).count() == 5


def test_registry_forms(spark):
    flat = {"A": {"protocols": {"p": {"endpoint": "srm://h1:1/x"}, "q": {"endpoint": "srm://h2/x"}}}, "B": {"protocols": {"p": {"endpoint": "http://h1/y"}}}}
    grouped = {"A": [{"protocols": {"p": {"endpoint": "srm://h1:1/x"}}}, {"protocols": {"q": {"endpoint": "h2"}}}], "B": [{"protocols": {"p": {"endpoint": "h1"}}}]}
    for document, is_grouped in ((flat, False), (grouped, True)):
        texts = spark.createDataFrame([(json.dumps(document),)], "d string")
        lines = texts.select(F.inline(files.parse_registry(F.col("d"), is_grouped)))
        sites = files.host_sites(files.registry_endpoints(lines, is_grouped))
        assert {tuple(r) for r in sites.collect()} == {("h1", "A"), ("h2", "A")}


def test_sessions_and_retention(spark):
    sessions = spark.createDataFrame([(1, T0), (2, T0), (3, None)], "session_id bigint, analysis_finished timestamp")
    table = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "issue_id bigint, session_id bigint")
    assert [r["issue_id"] for r in stores.latest_session(table, sessions).collect()] == [2]


def test_rewriting_a_session_leaves_the_others(spark):
    path = scratch_path(spark, "store")
    rows = [(1, {"A": "x"}, T0, T0, 1.0, 2, 3, 0, {"f": {"t": 2}})]
    issues = spark.createDataFrame(
        rows,
        "issue_id bigint, features map<string,string>, window_start timestamp, window_end timestamp, walltime_loss double, "
        "n_failed bigint, n_success bigint, payload_type int, error_strings map<string,map<string,bigint>>",
    )
    ticks = spark.createDataFrame([(1, T0, 1.0, 2)], "issue_id bigint, tick_time timestamp, walltime_loss double, nfailed_jobs bigint")
    for session in (1, 2, 2):
        stores.write_issue_store(issues, ticks, path, session)
    tables = stores.read_issue_store(spark, path)
    assert {n: t.count() for n, t in tables.items()} == {"issues": 2, "issue_meta": 2, "issue_ticks": 2}
    assert tables["issues"].first()["err_messages"] == '{"f":{"t":2}}'


def test_stream_equals_batch_over_several_files_with_late_rows(spark):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    schema = "SITE string, ENDTIME timestamp, LOSTWALLTIME double"
    batches = [
        [("a", T0, 1.0), ("a", T0 + datetime.timedelta(minutes=20), 2.0)],
        [("a", T0 + datetime.timedelta(minutes=10), 4.0), ("b", T0, 1.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{i}")
        stream = stw.stream_files(spark, f"{folder}/*", spark.createDataFrame([], schema).schema)
        query = stw.write_updates(stw.failure_windows(stream, ["SITE"]), f"{out}/t", f"{out}/c")
        query.awaitTermination()
    final = stw.read_updates(spark, f"{out}/t", ["SITE", "tick_time"])
    got = {(r["SITE"], r["tick_time"], r["walltime_loss"], r["nfailed_jobs"]) for r in final.collect()}
    assert got == {("a", T0, 5.0, 2), ("a", T0 + datetime.timedelta(minutes=15), 2.0, 1), ("b", T0, 1.0, 1)}


def vectors(spark):
    rows = [(i, [float(i % 2 * 5 + 1), float((i + 1) % 2 * 5 + 1), i / 50]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, "msg_id int, v array<double>")
    return df.withColumn("features", array_to_vector("v"))


def test_search_finds_two_clusters_and_zero_vectors_stand_aside(spark):
    usable, zero = clu.split_zero_vectors(vectors(spark))
    assert zero.count() == 1
    models = clu.search_k(usable, [2, 3], threads=2)
    metrics = clu.metrics_table(spark, models, "r")
    assert clu.best_k(metrics).first()["best_k"] == 2
    again = clu.train_kmeans(usable, 2)
    assert again.wsse == pytest.approx(models[0].wsse)
    predicted = clu.predict(again.model, vectors(spark))
    assert predicted.filter("msg_id = 99").first()["prediction"] == clu.NO_CLUSTER
    euclidean = clu.train_kmeans(usable, 2, distance="euclidean")
    assert euclidean.silhouette > 0.5


def test_silhouette_needs_two_clusters(spark):
    one = vectors(spark).filter("msg_id < 5").withColumn("prediction", F.lit(0))
    assert clu.silhouette(one) is None


def test_models_survive_storage(spark):
    path = scratch_path(spark, "model")
    model = clu.train_kmeans(clu.split_zero_vectors(vectors(spark))[0], 2).model
    clu.save_model(model, path)
    clu.save_model(model, path, overwrite=True)
    loaded = clu.load_kmeans(path)
    assert [list(c) for c in loaded.clusterCenters()] == [list(c) for c in model.clusterCenters()]


def test_word2vec_means_agree(spark):
    rows = [(i, ["a", "b", "c"][: i % 3 + 1] + (["rare%d" % i] if i % 2 else [])) for i in range(60)] + [(100, [])]
    tokens = spark.createDataFrame(rows, "msg_id int, stop_token_1 array<string>")
    model = clu.train_word2vec(tokens, embedding_size=4, min_count=5, partitions=1)
    from pyspark.ml.functions import vector_to_array

    words = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    by_join = {r["msg_id"]: r["vector"] for r in clu.mean_vectors(tokens, words, "msg_id", "stop_token_1").collect()}
    by_model = clu.vectorize(model, tokens).select("msg_id", vector_to_array("message_vector").alias("v"))
    for r in by_model.collect():
        assert by_join[r["msg_id"]] == pytest.approx(r["v"], abs=1e-6)


def test_predict_update_opens_a_cluster(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id int, v array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0], 2)], "cluster int, centroid array<double>, size bigint")
    assigned, moved = clu.predict_update(base, centers, "v", 0.5)
    assert {r["id"]: r["cluster"] for r in assigned.collect()} == {1: 0, 2: 0, 3: 1}
    rows = {r["cluster"]: (r["size"], r["centroid"]) for r in moved.collect()}
    assert rows[0][0] == 4 and rows[0][1] == pytest.approx([0.975, 0.025]) and rows[1] == (1, [0.0, 1.0])


def test_whole_analysis_of_messages(spark):
    rows = [(i, f"{['copy of file', 'timeout on host'][i % 2]} number {i % 4} failed", f"h{i % 3}", "d", 1_704_067_200_000) for i in range(80)]
    log = spark.createDataFrame(rows, "msg_id bigint, t__error_message string, src_hostname string, dst_hostname string, timestamp_tr_comp bigint")
    settings = plan.ClusterSettings(embedding_size=4, min_count=1, word2vec_partitions=1, k_values=[2, 3], search_max_iter=5, final_init_steps=2, final_max_iter=5)
    result, summary = plan.analyse_messages(log, settings=settings, n_rank=2)
    assert summary.agg(F.max("rank_pattern")).first()[0] == 2
    assert summary.select("prediction", "n_messages").distinct().agg(F.sum("n_messages")).first()[0] == 80
    again = plan.cluster_messages(log, settings)
    assert again.best.wsse == pytest.approx(result.best.wsse)


def test_mean_vectors_keep_every_message(spark):
    tokens = spark.createDataFrame([(1, ["a", "b"]), (2, ["x"]), (3, []), (4, None), (5, ["a", "a", "x"])], "id int, t array<string>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    got = {r["id"]: r["vector"] for r in clu.mean_vectors(tokens, words, "id", "t").collect()}
    assert got == {1: [0.5, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [pytest.approx(2 / 3), 0.0]}


def test_quality_sets_zero_vectors_aside(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [0.1, 1.0]), (1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "c int, v array<double>")
    got = {r["cluster"]: (r["size"], r["silhouette"]) for r in clu.cluster_quality(df, "v", "c").collect()}
    assert got[-1] == (1, None) and got[0][0] == got[1][0] == 2 and got[0][1] > 0.9


def test_choice_of_k_takes_a_silhouette_of_zero():
    models = [clu.ClusterModel(2, None, 3.0, -0.5, 0.0), clu.ClusterModel(4, None, 2.0, 0.0, 0.0), clu.ClusterModel(6, None, 1.0, None, 0.0)]
    assert plan._choose(models, "silhouette") == 4 and plan._choose(models, "wsse") == 6


def test_pipeline_sets_unknown_messages_aside(spark):
    from faultscope.plans.stages import clustering_pipeline

    rows = [(i, f"{['copy of file', 'timeout on host'][i % 2]} failed") for i in range(40)] + [(99, "unheard")]
    df = spark.createDataFrame(rows, "msg_id int, t__error_message string")
    settings = plan.ClusterSettings(embedding_size=4, min_count=2, final_init_steps=2, final_max_iter=5)
    got = {r["msg_id"]: r["prediction"] for r in clustering_pipeline(2, settings).fit(df).transform(df).collect()}
    assert got[99] == -1 and {got[i] for i in range(40)} <= {0, 1} and len(got) == 41


def test_registration_by_hand(spark):
    import difflib

    from faultscope.plans import issue_registration as registration

    first = [("copy of a file from the store failed at once", 5), ("copy of a file from the stor failed at once", 2), ("timeout", 1)]
    second = [("timeout", 7), ("copy of a file from the store failed at once!", 4), ("quite another message", 3)]
    stored = spark.createDataFrame([], registration.ISSUE_SCHEMA)
    categories = spark.createDataFrame([], registration.CATEGORY_SCHEMA)
    by_hand, amounts, stored_amounts = {}, {}, {}
    for run, part in enumerate((first, second)):
        rows = [(m, "s", "d", "t", n, run * 100 + i) for i, (m, n) in enumerate(part)]
        incoming = spark.createDataFrame(rows, "message string, src_site string, dst_site string, type string, amount bigint, id bigint")
        table, grown = registration.register_issues(stored, categories, incoming, F.lit(f"2024-01-0{run + 1}").cast("timestamp"))
        stored, categories = table.cache(), grown.cache()
        for message, n in part:
            amount = stored_amounts.setdefault(message, n)
            ratios = [(difflib.SequenceMatcher(None, message, c).ratio(), c) for c in amounts]
            best = max((r for r in ratios if r[0] > 0.95), key=lambda r: r[0], default=None)
            by_hand[message] = best[1] if best else message
            amounts[by_hand[message]] = amounts.get(by_hand[message], 0) + amount
    assert {r["message"]: r["category"] for r in stored.collect()} == by_hand
    assert {r["regex"]: r["amount"] for r in categories.collect()} == amounts
    assert {r["message"]: r["amount"] for r in stored.collect()} == stored_amounts


def test_parts_arrive_in_many_files_and_one_batch(spark, tmp_path):
    from workload import fixtures as fix

    parts = [spark.range(k * 100, k * 100 + 40).repartition(4) for k in range(3)]
    source, batches = str(tmp_path / "source"), []

    def run():
        stream = spark.readStream.schema("id bigint").parquet(source)
        query = stream.writeStream.foreachBatch(lambda b, n: batches.append((n, sorted(r[0] for r in b.collect()), len(b.inputFiles()))))
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    fix.arrive(parts, source, "parquet", run)
    assert [(n, ids) for n, ids, _ in batches] == [(k, list(range(k * 100, k * 100 + 40))) for k in range(3)]
    assert len(list((tmp_path / "source").glob("*.parquet"))) == 12
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
