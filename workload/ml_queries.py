"""Queries over vectors and clusterings."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.operators import clustering as clu
from faultscope.operators import cooccurrence as cooc
from faultscope.operators import messages as msg
from faultscope.operators.k_search import search_shared
from faultscope.plans import message_clustering as plan
from faultscope.plans.stages import (
    Detokenizer,
    MessageTokenizer,
    PatternAbstractor,
    WordRemover,
    clustering_pipeline,
)
from faultscope.session import cut_lineage, scratch_path
from faultscope.sources import stores
from faultscope.streaming import clustering as clu_stream
from faultscope.streaming.windows import stream_files
from workload import fixtures as fix
from workload.fixtures import oracle
from workload.text_queries import ABSTRACT_CTE, token_ctes


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = fix.table(spark, folder, "embeddings")
    return vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))


def _centers(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label."""
    return clu.centroids(_vectors(spark, folder), "embedding", "label")


def _by_dimension(df: DataFrame, key: str, vector: str, digits: int = 5) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("dim", "x")).select(
        key, "dim", F.round("x", digits).alias("x")
    )


def vector_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Users as messages of words, one per event; the embeddings are the vectors of the first
    words, all others are unknown, and some users have unknown words only."""
    events = fix.table(spark, folder, "events")
    number = F.when(F.col("user_id") % 9 == 4, -1).otherwise(F.col("event_id") % 700)
    said = events.select("user_id", F.concat(F.lit("w"), number).alias("word"))
    words = _vectors(spark, folder).select(
        F.concat(F.lit("w"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vector")
    )
    return _by_dimension(clu.mean_of_words(said, words, "user_id"), "user_id", "vector")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    centers = clu.centroids(_vectors(spark, folder), "embedding", "label")
    sized = centers.select("cluster", "size", F.posexplode("centroid").alias("dim", "x"))
    return sized.withColumn("x", F.round("x", 5))


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    near = clu.nearest_centroid(_vectors(spark, folder), _centers(spark, folder), "embedding")
    return near.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def nearest_centroid_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    near = clu.nearest_centroid(
        _vectors(spark, folder), _centers(spark, folder), "embedding", "euclidean"
    )
    return near.select("vec_id", "cluster", F.round("distance", 5).alias("distance"))


def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The labels as clusters; every fiftieth vector is zero."""
    vectors = _vectors(spark, folder)
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    vectors = vectors.withColumn("embedding", F.when(F.col("vec_id") % 50 == 7, zero).otherwise(F.col("embedding")))
    quality = clu.cluster_quality(vectors, "embedding", "label")
    return quality.select(
        "cluster", "size", F.round("wsse", 4).alias("wsse"), F.round("silhouette", 5).alias("silhouette")
    )


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A table of search results, one per language and day of the month."""
    events = fix.table(spark, folder, "events")
    return events.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("k")).agg(
        F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("wsse"),
        F.round(F.avg(F.col("value").cast("decimal(18,2)")).cast("double") / 100, 6).alias("silhouette"),
    )


def best_k(spark: SparkSession, folder: str) -> DataFrame:
    metrics = _metrics(spark, folder)
    by_silhouette = clu.best_k(metrics, "silhouette", ["run"]).withColumnRenamed("best_k", "by_silhouette")
    by_wsse = clu.best_k(metrics, "wsse", ["run"]).withColumnRenamed("best_k", "by_wsse")
    return by_silhouette.join(by_wsse, "run")


def metric_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = clu.metric_curve(_metrics(spark, folder), ["run"])
    return curve.withColumn("log_wsse", F.round("log_wsse", 6))


def predict_update(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors against the centroids of the first five labels: those beyond the threshold open a
    new cluster, the others move their centroid."""
    vectors = _vectors(spark, folder)
    centers = _centers(spark, folder).filter("cluster < 5")
    assigned, _ = clu.predict_update(vectors, centers, "embedding", 0.5)
    return assigned.select("vec_id", "cluster")


def updated_centroids(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    centers = _centers(spark, folder).filter("cluster < 5")
    _, moved = clu.predict_update(vectors, centers, "embedding", 0.5)
    sized = moved.select("cluster", "size", F.posexplode("centroid").alias("dim", "x"))
    return sized.withColumn("x", F.round("x", 4))


def _pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words beside words, counted for the first half of the month and then added up with the second."""
    log = fix.messages(spark, folder)
    tokens = F.filter(F.split(F.lower("t__error_message"), r"\s+"), lambda w: w != "")
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    path = scratch_path(spark, "pairs")
    for name, half in (("first", first), ("second", ~first)):
        said = log.filter(half).select(tokens.alias("tokens"))
        cooc.pair_counts(said, "tokens", 3).write.parquet(f"{path}/{name}")
    return cooc.add_counts(spark.read.parquet(f"{path}/first"), spark.read.parquet(f"{path}/second"))


def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_counts(spark, folder)


def shifted_ppmi(spark: SparkSession, folder: str) -> DataFrame:
    rated = cooc.shifted_ppmi(_pair_counts(spark, folder), min_count=50, shift=1.5)
    return rated.select("word", "context", F.round("value", 6).alias("value"))


def word_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Words along the three leading directions of their PMI, without signs."""
    rated = cooc.shifted_ppmi(_pair_counts(spark, folder), min_count=50, shift=1.5)
    vectors = cooc.word_vectors(rated, 3, rounds=8)
    return vectors.select("word", F.posexplode("vector").alias("dim", "x")).select("word", "dim", F.round(F.abs("x"), 4).alias("x"))


FOLLOW = clu_stream.FollowSettings(threshold=0.5, new_clusters=3, decay=0.9)


def stream_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of the first five labels that follow all vectors, which arrive in three files: their final state."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "centroids")
    vectors = fix.table(spark, folder, "embeddings").select("vec_id", "embedding")
    for k in range(3):
        vectors.filter(F.col("vec_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    store = clu_stream.CentroidStore(spark, path)
    store.write(_centers(spark, folder).filter("cluster < 5"), -1)
    stream = stream_files(spark, source, vectors.schema, maxFilesPerTrigger=1)
    clu_stream.follow_stream(stream, path, f"{path}/checkpoint", "vec_id", "embedding", FOLLOW).awaitTermination()
    sizes = store.predictions().groupBy(F.col("cluster").alias("given")).agg(F.count("*").alias("n_given"))
    final = store.read().join(sizes, F.col("cluster") == F.col("given"), "left")
    sized = final.select("cluster", F.round("size", 4).alias("size"), "n_given", F.posexplode("centroid").alias("dim", "x"))
    return sized.withColumn("x", F.round("x", 4))


# Smaller models than the defaults: 8 dimensions, few initial steps and iterations. The embedding
# is trained in as many tasks as the session shuffles to.
SETTINGS = plan.ClusterSettings(
    embedding_size=8,
    window=5,
    min_count=5,
    k_values=[4, 6],
    search_max_iter=10,
    final_init_steps=10,
    final_max_iter=20,
)


def _known_vectors(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "msg_id", vector_to_array("features").alias("vector"), F.col("prediction").alias("given")
    )


def word2vec_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Training, model files, inference from the files: how many messages have a prediction, and
    how many the nearest of the saved centroids."""
    messages = fix.messages(spark, folder)
    result = plan.cluster_messages(messages, SETTINGS)
    path = scratch_path(spark, "models")
    clu.save_model(result.word2vec, f"{path}/w2v")
    clu.save_model(result.best.model, f"{path}/kmeans")
    kmeans = clu.load_kmeans(f"{path}/kmeans")
    inferred = plan.infer_clusters(messages, clu.load_word2vec(f"{path}/w2v"), kmeans, SETTINGS)
    near = clu.nearest_centroid(_known_vectors(inferred), clu.model_centroids(spark, kmeans), "vector")
    return near.agg(
        F.count("given").alias("n_messages"), F.count_if(F.col("given") == F.col("cluster")).alias("n_nearest")
    )


def training_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The log of a search against the assignment to the final centroids: the same silhouette, and
    a cost not above the logged one, which is that of the last step's beginning."""
    tokenized = msg.tokenize_messages(fix.messages(spark, folder))
    with clu.kept(tokenized.select("msg_id", "stop_token_1")) as tokens:
        vectors = clu.vectorize(clu.train_word2vec(tokens, embedding_size=8, window=5, min_count=5), tokens)
        features = cut_lineage(clu.assemble_features(vectors).select("msg_id", "features"))
    features = clu.split_zero_vectors(features)[0]
    models = clu.search_k(features, [2, 4, 6], max_iter=5)
    log = scratch_path(spark, "training-log")
    stores.append_training_log(clu.metrics_table(spark, models, "search"), log)
    checked = []
    for m in models:
        known = _known_vectors(m.model.transform(features))
        quality = clu.cluster_quality(known, "vector", "given")
        near = clu.nearest_centroid(known, clu.model_centroids(spark, m.model), "vector")
        mean = quality.agg((F.sum(F.col("silhouette") * F.col("size")) / F.sum("size")).alias("mean"))
        # Two single rows.
        one = near.agg(F.sum("distance").alias("cost")).crossJoin(mean)
        checked.append(one.withColumn("k", F.lit(m.k)))
    recomputed = checked[0].unionByName(checked[1]).unionByName(checked[2])
    return spark.read.parquet(log).join(recomputed, "k").select(
        "run", "k", (F.col("cost") <= F.col("wsse") * (1 + 1e-6)).alias("bounded_wsse"),
        (F.abs(F.col("silhouette") - F.col("mean")) < 1e-6).alias("same_silhouette"),
    )


def shared_search(spark: SparkSession, folder: str) -> DataFrame:
    """Models of four K over all embeddings, advanced together."""
    features = _vectors(spark, folder).select(array_to_vector("embedding").alias("features"))
    models = search_shared(features, [2, 3, 5, 8], max_iter=10)
    rows = [(m.k, m.steps, round(m.wsse, 6), round(m.silhouette, 6)) for m in models]
    return spark.createDataFrame(rows, "k int, steps int, wsse double, silhouette double")


def analysed(spark: SparkSession, folder: str) -> tuple[plan.ClusterResult, DataFrame]:
    return plan.analyse_messages(fix.messages(spark, folder), settings=SETTINGS, n_rank=3)


def message_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """From raw messages to the summary of their clusters: the first three patterns, sources and destinations of each."""
    return analysed(spark, folder)[1].drop("clust_UUID", "model_ref")


def clustering_run(spark: SparkSession, folder: str) -> DataFrame:
    """Two training runs with stored models and log, then a run that loads the newest: per run the
    messages with a cluster, and those that the loaded models give the same one."""
    path = scratch_path(spark, "clustering")
    log = fix.messages(spark, folder)
    trained = {run: cut_lineage(plan.run_clustering(log, path, run, "train", SETTINGS).select("msg_id", "prediction")) for run in ("run-1", "run-2")}
    loaded = plan.run_clustering(log, path, "", "load", SETTINGS).select("msg_id", F.col("prediction").alias("loaded"))
    logged = spark.read.parquet(f"{path}/training-log").groupBy("run").agg(F.count("*").alias("n_models"))
    newest = trained["run-2"].join(loaded, "msg_id")
    return newest.agg(
        F.count("prediction").alias("n_messages"), F.count_if(F.col("prediction") == F.col("loaded")).alias("n_same")
    ).crossJoin(logged.agg(F.count("*").alias("n_runs"), F.sum("n_models").alias("n_models")))


def token_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, patterns and texts from pipeline stages."""
    stages = [
        MessageTokenizer(inputCol="t__error_message", outputCol="cleaned"),
        WordRemover(inputCol="cleaned", outputCol="kept"),
        PatternAbstractor(inputCol="cleaned", outputCol="pattern"),
        Detokenizer(inputCol="kept", outputCol="kept_text"),
        Detokenizer(inputCol="pattern", outputCol="pattern_text"),
    ]
    log = fix.messages(spark, folder).select("msg_id", "t__error_message")
    return Pipeline(stages=stages).fit(log).transform(log).select("msg_id", "kept_text", "pattern_text")


def fitted_pipeline(spark: SparkSession, folder: str) -> tuple[PipelineModel, DataFrame]:
    log = fix.messages(spark, folder).select("msg_id", "t__error_message")
    return clustering_pipeline(4, SETTINGS).fit(log), log


def pipeline_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Messages in each of four clusters, and in -1."""
    model, log = fitted_pipeline(spark, folder)
    return model.transform(log).groupBy("prediction").agg(F.count("*").alias("n_messages"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_mean, centroids, nearest_centroid, nearest_centroid_euclidean, cluster_quality,
        best_k, metric_curve, predict_update, updated_centroids, stream_clusters,
        pair_counts, shifted_ppmi, word_directions, word2vec_kmeans, training_metrics, shared_search,
        message_analysis, clustering_run, token_stages, pipeline_clusters,
    )
}

# -- SQL ------------------------------------------------------------------------------------

_FLAT = """
WITH flat AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""
_CENTERS = (
    _FLAT
    + """,
center AS (SELECT label AS cluster, dim, avg(x) AS c FROM flat GROUP BY label, dim)"""
)
_COSINE = """,
scored AS (
  SELECT vec_id, cluster, 1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS distance
  FROM flat JOIN center ON center.dim = flat.dim{where} GROUP BY vec_id, cluster),
near AS (SELECT vec_id, arg_min(cluster, distance) AS cluster, min(distance) AS distance FROM scored GROUP BY vec_id)"""
_FIVE = _CENTERS + _COSINE.format(where=" AND cluster < 5")
_METRICS = """
WITH metrics AS (
  SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS k, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS wsse,
    round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) / 100, 6) AS silhouette FROM events GROUP BY ALL)"""

_PAIRS = r"""said AS (
  SELECT msg_id, list_filter(string_split_regex(lower(t__error_message), '\s+'), lambda x: x <> '') AS t FROM messages),
place AS (SELECT msg_id, unnest(t) AS word, unnest(range(len(t))) AS at FROM said),
pairs AS (
  SELECT a.word, b.word AS context, count(*) AS n FROM place a JOIN place b
  ON a.msg_id = b.msg_id AND a.at <> b.at AND abs(a.at - b.at) <= 3 GROUP BY ALL)"""

SQL = {
    "pair_counts": oracle("messages", _PAIRS + " SELECT * FROM pairs"),
    "shifted_ppmi": oracle(
        "messages",
        _PAIRS
        + """,
often AS (SELECT word FROM pairs GROUP BY word HAVING sum(n) >= 50),
kept AS (SELECT * FROM pairs WHERE word IN (SELECT word FROM often) AND context IN (SELECT word FROM often)),
totals AS (SELECT word, sum(n) AS total FROM kept GROUP BY word),
rated AS (
  SELECT k.word, context, ln(n::DOUBLE * (SELECT sum(n) FROM kept) / (a.total::DOUBLE * b.total)) - ln(1.5) AS value
  FROM kept k JOIN totals a ON a.word = k.word JOIN totals b ON b.word = k.context)
SELECT word, context, round(value, 6) AS value FROM rated WHERE value > 0""",
    ),
    "word2vec_kmeans": "SELECT count(*) AS n_messages, count(*) AS n_nearest FROM events",
    "training_metrics": "SELECT 'search' AS run, k, true AS bounded_wsse, true AS same_silhouette FROM (VALUES (2), (4), (6)) v(k)",
    "clustering_run": "SELECT count(*) AS n_messages, count(*) AS n_same, CAST(2 AS BIGINT) AS n_runs, CAST(4 AS BIGINT) AS n_models FROM events",
    "token_stages": oracle(
        "messages",
        token_ctes("messages", "msg_id", "t__error_message")
        + f""",{ABSTRACT_CTE} SELECT msg_id, array_to_string(stop_token_1, ' ') AS kept_text,
  array_to_string(abstract_message, ' ') AS pattern_text FROM abstracted""",
    ),
    "vector_mean": """
WITH token AS (SELECT user_id, CASE WHEN user_id % 9 = 4 THEN -1 ELSE event_id % 700 END AS w FROM events),
sizes AS (SELECT user_id, count(*) AS n FROM token GROUP BY user_id),
flat AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
sums AS (SELECT t.user_id, dim, sum(x) AS x FROM token t JOIN flat f ON f.vec_id = t.w GROUP BY t.user_id, dim)
SELECT s.user_id, CAST(d.dim AS INTEGER) AS dim, coalesce(round(x / n, 5), 0) AS x FROM sizes s
CROSS JOIN (SELECT DISTINCT dim FROM flat) d LEFT JOIN sums m ON m.user_id = s.user_id AND m.dim = d.dim""",
    "centroids": _FLAT
    + " SELECT label AS cluster, count(*) AS size, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS x FROM flat GROUP BY label, dim",
    "nearest_centroid": _CENTERS
    + _COSINE.format(where="")
    + " SELECT vec_id, cluster, round(distance, 6) AS distance FROM near",
    "nearest_centroid_euclidean": _CENTERS
    + """,
scored AS (
  SELECT vec_id, cluster, sqrt(sum((x - c) * (x - c))) AS distance FROM flat JOIN center ON center.dim = flat.dim GROUP BY vec_id, cluster)
SELECT vec_id, arg_min(cluster, distance) AS cluster, round(min(distance), 5) AS distance FROM scored GROUP BY vec_id""",
    "cluster_quality": _FLAT.replace("WITH flat", "WITH every")
    + """,
flat AS (SELECT * FROM every WHERE vec_id % 50 <> 7),
norm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM flat GROUP BY vec_id),
unit AS (SELECT f.*, x / n AS u FROM flat f JOIN norm ON norm.vec_id = f.vec_id),
mean AS (SELECT label, dim, avg(x) AS m, avg(u) AS mu, count(*) AS size FROM unit GROUP BY label, dim),
spread AS (SELECT f.label, sum((x - m) * (x - m)) AS wsse FROM flat f JOIN mean ON mean.label = f.label AND mean.dim = f.dim GROUP BY f.label),
far AS (
  SELECT vec_id, unit.label, mean.label AS other, any_value(size) AS size, 1 - sum(u * mu) AS d
  FROM unit JOIN mean ON mean.dim = unit.dim GROUP BY vec_id, unit.label, mean.label),
rated AS (
  SELECT vec_id, label, max(d * size / (size - 1)) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b
  FROM far GROUP BY vec_id, label)
SELECT r.label AS cluster, count(*) AS size, round(any_value(wsse), 4) AS wsse, round(avg((b - a) / greatest(a, b)), 5) AS silhouette
FROM rated r JOIN spread s ON s.label = r.label GROUP BY r.label
UNION ALL SELECT -1, count(*), 0.0, NULL FROM embeddings WHERE vec_id % 50 = 7 HAVING count(*) > 0""",
    "best_k": _METRICS
    + """ SELECT run, first(k ORDER BY silhouette DESC, k) AS by_silhouette, first(k ORDER BY wsse, k) AS by_wsse FROM metrics GROUP BY run""",
    "metric_curve": _METRICS
    + """ SELECT run, k, round(ln(wsse), 6) AS log_wsse, silhouette, silhouette = max(silhouette) OVER (PARTITION BY run) AS is_best_silhouette,
  wsse = min(wsse) OVER (PARTITION BY run) AS is_best_wsse FROM metrics""",
    "predict_update": _FIVE
    + " SELECT vec_id, CAST(CASE WHEN distance > 0.5 THEN 5 ELSE cluster END AS INTEGER) AS cluster FROM near",
    "updated_centroids": _FIVE
    + """,
sizes AS (SELECT label AS cluster, count(*) AS size FROM embeddings WHERE label < 5 GROUP BY label),
added AS (
  SELECT n.cluster, f.dim, sum(x) AS s, count(*) AS n FROM near n JOIN flat f ON f.vec_id = n.vec_id
  WHERE n.distance <= 0.5 GROUP BY n.cluster, f.dim),
fresh AS (SELECT dim, avg(x) AS x, count(*) AS size FROM near n JOIN flat f ON f.vec_id = n.vec_id WHERE n.distance > 0.5 GROUP BY dim)
SELECT c.cluster, size + coalesce(n, 0) AS size, CAST(c.dim AS INTEGER) AS dim, round((c.c * size + coalesce(s, 0)) / (size + coalesce(n, 0)), 4) AS x
FROM center c JOIN sizes z ON z.cluster = c.cluster LEFT JOIN added a ON a.cluster = c.cluster AND a.dim = c.dim
UNION ALL SELECT 5, size, CAST(dim AS INTEGER), round(x, 4) FROM fresh""",
}
