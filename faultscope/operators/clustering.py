"""Embedding and clustering of tokenised messages."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultscope.session import stored

# The name the evaluator has for each distance of the clustering.
EVALUATOR_DISTANCE = {"cosine": "cosine", "euclidean": "squaredEuclidean"}

METRICS_SCHEMA = "run string, k int, wsse double, silhouette double, seconds double"

# Cluster of messages without any known word.
NO_CLUSTER = -1

# Numbers in all centroids of a model that is sent to the tasks: 160 MB.
MOST_NUMBERS = 20_000_000


@dataclass(frozen=True)
class ClusterModel:
    k: int
    model: KMeansModel
    wsse: float
    silhouette: float | None
    seconds: float


# -- embedding ------------------------------------------------------------------------------


def train_word2vec(
    tokenized: DataFrame,
    tokens_col: str = "stop_token_1",
    out_col: str = "message_vector",
    embedding_size: int = 150,
    window: int = 8,
    min_count: int = 500,
    partitions: int | None = None,
    seed: int = 42,
    max_iter: int = 1,
) -> Word2VecModel:
    """Skip-gram embedding of the tokens, in as many tasks as the session shuffles to unless told
    otherwise. The result depends on the number of partitions."""
    partitions = partitions or int(tokenized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word2vec = Word2Vec(
        vectorSize=embedding_size,
        windowSize=window,
        minCount=min_count,
        numPartitions=partitions,
        maxIter=max_iter,
        seed=seed,
        inputCol=tokens_col,
        outputCol=out_col,
    )
    return fit_words(word2vec, tokenized)


@contextmanager
def kept(frame: DataFrame) -> Iterator[DataFrame]:
    """The frame, held in memory and on the executors' disks inside the block; its partitions stay as they are."""
    held = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def fit_words(word2vec: Word2Vec, tokenized: DataFrame) -> Word2VecModel:
    """The embedding of the tokens. A fit reads them twice, for the vocabulary and for the training, so they are
    kept meanwhile, unless the caller keeps the frame."""
    words = tokenized.select(word2vec.getInputCol())
    if tokenized.is_cached:
        return word2vec.fit(words)
    with kept(words):
        return word2vec.fit(words)


def save_model(model: Word2VecModel | KMeansModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_word2vec(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def vectorize(model: Word2VecModel, tokenized: DataFrame) -> DataFrame:
    """Adds the mean vector of the tokens; unknown tokens count as zero."""
    return model.transform(tokenized)


def mean_vectors(
    tokenized: DataFrame, word_vectors: DataFrame, id_col: str, tokens_col: str, out_col: str = "vector"
) -> DataFrame:
    """The same from a word vector table (``word``, ``vector`` as array of doubles), one row per
    message; those without tokens or known words get the zero vector."""
    return mean_of_words(tokenized.select(id_col, F.explode_outer(tokens_col).alias("word")), word_vectors, id_col, out_col)


def mean_of_words(words: DataFrame, word_vectors: DataFrame, id_col: str, out_col: str = "vector") -> DataFrame:
    """Mean vector of the words of each id, from rows of id and ``word``; a null word stands for none.

    Words are counted per message first, then summed as weighted vectors in the JVM. A message with
    a large share of all words is added up map-side.
    """
    counted = words.groupBy(id_col, "word").agg(F.count("word").alias("_times"))
    sizes = counted.groupBy(F.col(id_col).alias("_id")).agg(F.sum("_times").alias("_n"))
    vectors = word_vectors.select("word", array_to_vector(F.col("vector")).alias("_vector"))
    summed = (
        counted.join(vectors, "word")
        .groupBy(id_col)
        .agg(vector_to_array(Summarizer.sum(F.col("_vector"), F.col("_times").cast("double"))).alias("_sum"))
    )
    # The weights of the known words sum to the message's known words, not to all of them.
    mean = F.transform("_sum", lambda x: x / F.col("_n"))
    width = word_vectors.agg(F.max(F.size("vector"))).scalar()
    zero = F.array_repeat(F.lit(0.0), F.coalesce(width, F.lit(0)))
    joined = sizes.join(summed, F.col("_id").eqNullSafe(F.col(id_col)), "left")
    return joined.select(F.col("_id").alias(id_col), F.coalesce(mean, zero).alias(out_col))


def assemble_features(
    vectors: DataFrame, vector_col: str = "message_vector", out_col: str = "features"
) -> DataFrame:
    return VectorAssembler(inputCols=[vector_col], outputCol=out_col).transform(vectors)


def split_zero_vectors(features: DataFrame, features_col: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows with a direction, and rows whose vector is zero: no cosine distance is defined for
    these."""
    nonzero = _nonzero(features_col)
    return features.filter(nonzero), features.filter(~nonzero)


def _nonzero(features_col: str) -> Column:
    return F.exists(vector_to_array(features_col), lambda x: x != 0)


# -- K-Means --------------------------------------------------------------------------------


def silhouette(
    predictions: DataFrame,
    distance: str = "cosine",
    features_col: str = "features",
    clust_col: str = "prediction",
) -> float | None:
    """Mean silhouette, none if fewer than two clusters have members."""
    if predictions.select(clust_col).distinct().limit(2).count() < 2:
        return None
    evaluator = ClusteringEvaluator(
        featuresCol=features_col,
        predictionCol=clust_col,
        distanceMeasure=EVALUATOR_DISTANCE[distance],
    )
    return evaluator.evaluate(predictions)


def train_kmeans(
    features: DataFrame,
    k: int,
    features_col: str = "features",
    distance: str = "cosine",
    init_steps: int = 10,
    tol: float = 1e-4,
    max_iter: int = 30,
    seed: int = 42,
) -> ClusterModel:
    """K-Means‖ with its within-cluster cost, silhouette and run time."""
    started = time.monotonic()
    model = KMeans(
        featuresCol=features_col,
        k=k,
        initMode="k-means||",
        initSteps=init_steps,
        tol=tol,
        maxIter=max_iter,
        distanceMeasure=distance,
        seed=seed,
    ).fit(features)
    quality = silhouette(model.transform(features), distance, features_col)
    return ClusterModel(
        k, model, model.summary.trainingCost, quality, time.monotonic() - started
    )


def search_k(
    features: DataFrame,
    k_values: list[int],
    threads: int = 5,
    **options,
) -> list[ClusterModel]:
    """One model per K. The features are kept while the threads submit their jobs."""
    kept = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            return list(pool.map(lambda k: train_kmeans(kept, k, **options), k_values))
    finally:
        kept.unpersist()


def metrics_table(spark: SparkSession, models: list[ClusterModel], run: str) -> DataFrame:
    """The metrics of a search, one row per K: the log of the training."""
    rows = [(run, m.k, m.wsse, m.silhouette, m.seconds) for m in models]
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def best_k(metrics: DataFrame, by: str = "silhouette", group_cols: list[str] | None = None) -> DataFrame:
    """The K with the largest silhouette or the smallest WSSE (smallest K on ties)."""
    if by not in ("silhouette", "wsse"):
        raise ValueError("choose silhouette or wsse")
    score = F.col("silhouette") if by == "silhouette" else -F.col("wsse")
    rated = metrics.filter(score.isNotNull())
    rank = F.struct(score, -F.col("k"))
    return rated.groupBy(*(group_cols or [])).agg(F.max_by("k", rank).alias("best_k"))


def metric_curve(metrics: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """log(WSSE) and silhouette per K, with the best of each marked, for one search or one per group."""
    groups = group_cols or []
    # A window holds the rows of one search: one per K.
    search = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return metrics.select(
        *groups,
        "k",
        F.log("wsse").alias("log_wsse"),
        "silhouette",
        (F.col("silhouette") == F.max("silhouette").over(search)).alias("is_best_silhouette"),
        (F.col("wsse") == F.min("wsse").over(search)).alias("is_best_wsse"),
    )


# -- prediction -----------------------------------------------------------------------------


def predict(model: KMeansModel, features: DataFrame, features_col: str = "features") -> DataFrame:
    """Adds the nearest cluster; rows with a zero vector get cluster -1.

    One pass without a filter, which Spark would push below the vectors and so compute them again: a zero
    vector goes through the model as one of ones, and its prediction is not taken.
    """
    cosine = model.getOrDefault("distanceMeasure") == "cosine"
    if not cosine:
        return model.transform(features)
    nonzero, found = _nonzero(features_col), model.getPredictionCol()
    ones = array_to_vector(F.array_repeat(F.lit(1.0), len(model.clusterCenters()[0])))
    placed = features.withColumn("_placed", F.when(nonzero, F.col(features_col)).otherwise(ones))
    scored = model.copy({model.featuresCol: "_placed"}).transform(placed)
    return scored.withColumn(found, F.when(nonzero, F.col(found)).otherwise(NO_CLUSTER)).drop("_placed")


def centroids(vectors: DataFrame, vector_col: str, clust_col: str) -> DataFrame:
    """Mean vector (array) and size of each cluster."""
    return vectors.groupBy(F.col(clust_col).alias("cluster")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector_col)))).alias("centroid"),
        F.count("*").alias("size"),
    )


def model_centroids(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


def nearest_centroid(
    vectors: DataFrame, centers: DataFrame, vector_col: str, distance: str = "cosine"
) -> DataFrame:
    """Adds ``cluster`` and ``distance`` of the nearest centroid (smallest cluster on ties).

    The centroids are the K rows of a model and go with the tasks, ``MOST_NUMBERS`` in all at most; the vectors stream
    past them in Arrow batches, one matrix product each. Zero vectors get cluster -1, and all do where there is no centroid.
    """
    held = centers.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    if held > MOST_NUMBERS:
        raise ValueError(f"centroids of {held} numbers are more than a task should hold")
    if not held:
        none = F.lit(NO_CLUSTER).alias("cluster"), F.lit(None).cast("double").alias("distance")
        return vectors.select(*vectors.columns, *none)
    rows = centers.orderBy("cluster").select("cluster", "centroid").collect()
    names = np.array([r["cluster"] for r in rows])
    matrix = np.array([r["centroid"] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    schema = T.StructType(
        [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    )

    @F.pandas_udf(schema)
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = np.stack(batch.to_numpy()).astype(np.float64)
            if distance == "cosine":
                sizes = np.linalg.norm(points, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = 1.0 - (points @ matrix.T) / np.outer(sizes, norms)
                far[sizes == 0] = np.nan
            else:
                squares = (points**2).sum(axis=1)[:, None] + (norms**2)[None, :]
                far = np.sqrt(np.maximum(squares - 2.0 * points @ matrix.T, 0.0))
            known = ~np.isnan(far).all(axis=1)
            best = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
            yield pd.DataFrame(
                {
                    "cluster": np.where(known, names[best], NO_CLUSTER),
                    "distance": np.where(known, far[np.arange(len(best)), best], np.nan),
                }
            )

    return vectors.withColumn("_near", nearest(F.col(vector_col))).select(
        *vectors.columns, F.col("_near.cluster").alias("cluster"), F.col("_near.distance").alias("distance")
    )


def updated_centroids(
    assigned: DataFrame, centers: DataFrame, vector_col: str, threshold: float
) -> DataFrame:
    """Centroids after taking in the vectors no farther than the threshold.

    ``centers`` has ``cluster, centroid, size``; the new mean weighs the old one by its size.
    """
    near = assigned.filter((F.col("cluster") != NO_CLUSTER) & (F.col("distance") <= threshold))
    added = near.groupBy(F.col("cluster").alias("_cluster")).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(vector_col).cast("array<double>")))).alias("_sum"),
        F.count("*").alias("_n"),
    )
    size = F.col("size") + F.coalesce("_n", F.lit(0))
    weighted = F.zip_with("centroid", "_sum", lambda c, s: (c * F.col("size") + s) / size)
    return centers.join(added, F.col("cluster") == F.col("_cluster"), "left").select(
        "cluster",
        F.when(F.col("_n").isNull(), F.col("centroid")).otherwise(weighted).alias("centroid"),
        size.alias("size"),
    )


def predict_update(
    vectors: DataFrame,
    centers: DataFrame,
    vector_col: str,
    threshold: float,
    new_clusters: int = 1,
    distance: str = "cosine",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Online prediction: vectors beyond the threshold open new clusters, the others move the
    centroid of theirs. Returns the assigned vectors and the new centroids."""
    # Scored once; both results and the search for far vectors read it.
    assigned = stored(nearest_centroid(vectors, centers, vector_col, distance), "assigned")
    known = updated_centroids(assigned, centers, vector_col, threshold)
    far = (F.col("cluster") != NO_CLUSTER) & (F.col("distance") > threshold)
    beyond = assigned.filter(far).drop("cluster", "distance")
    if not beyond.limit(1).count():
        return assigned, known
    first = centers.agg(F.max("cluster")).first()[0] + 1
    if new_clusters == 1:
        opened = beyond.withColumn("cluster", F.lit(first))
    else:
        features = array_to_vector(F.col(vector_col).cast("array<double>"))
        ready = beyond.withColumn("_features", features)
        kmeans = KMeans(featuresCol="_features", k=new_clusters, distanceMeasure=distance, seed=seed)
        number = (F.col("prediction") + first).cast("int")
        opened = kmeans.fit(ready).transform(ready).withColumn("cluster", number)
    moved = opened.withColumn("distance", F.lit(None).cast("double")).select(assigned.columns)
    new_rows = centroids(
        moved.withColumn(vector_col, F.col(vector_col).cast("array<double>")), vector_col, "cluster"
    )
    return assigned.filter(~far).unionByName(moved), known.unionByName(new_rows)


# -- quality of given labels ----------------------------------------------------------------


def cluster_quality(vectors: DataFrame, vector_col: str, clust_col: str) -> DataFrame:
    """Size, within-cluster sum of squares and mean cosine silhouette of each given cluster.

    Zero vectors have no direction: they stand aside as cluster -1, without a silhouette. The mean cosine distance of a vector to a cluster is one minus its product with the mean of
    the cluster's unit vectors, so K mean vectors replace all pairs of rows.
    """
    arrays = vectors.select(clust_col, F.col(vector_col).cast("array<double>").alias("_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    measured = arrays.withColumn("_length", length)
    units = measured.filter("_length > 0").withColumn("_unit", F.transform("_v", lambda x: x / F.col("_length")))
    means = (
        units.groupBy(F.col(clust_col).alias("cluster"))
        .agg(
            vector_to_array(Summarizer.mean(array_to_vector(F.col("_v")))).alias("mean"),
            vector_to_array(Summarizer.mean(array_to_vector(F.col("_unit")))).alias("unit_mean"),
            F.count("*").alias("size"),
        )
    )
    listed = means.agg(F.collect_list(F.struct("cluster", "mean", "unit_mean", "size")))

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def squared(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
        )

    clusters = F.col("_clusters")
    own = F.get(F.filter(clusters, lambda c: c["cluster"] == F.col(clust_col)), F.lit(0))
    others = F.filter(clusters, lambda c: c["cluster"] != F.col(clust_col))
    inner = (F.lit(1.0) - product(F.col("_unit"), F.col("_own.unit_mean"))) * (
        F.col("_own.size") / (F.col("_own.size") - 1)
    )
    outer = F.array_min(
        F.transform(others, lambda c: F.lit(1.0) - product(F.col("_unit"), c["unit_mean"]))
    )
    rated = (
        units.withColumn("_clusters", listed.scalar())
        .withColumn("_own", own)
        .select(
            F.col(clust_col).alias("cluster"),
            squared(F.col("_v"), F.col("_own.mean")).alias("_square"),
            F.when(F.col("_own.size") > 1, inner).alias("_a"),
            outer.alias("_b"),
        )
    )
    score = F.when(F.col("_a").isNull(), F.lit(0.0)).otherwise(
        (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")
    )
    quality = rated.groupBy("cluster").agg(
        F.count("*").alias("size"), F.sum("_square").alias("wsse"), F.avg(score).alias("silhouette")
    )
    aside = measured.filter("_length = 0").agg(F.count("*").alias("size")).filter("size > 0")
    kind = quality.schema["cluster"].dataType
    return quality.unionByName(
        aside.select(F.lit(NO_CLUSTER).cast(kind).alias("cluster"), "size", F.lit(0.0).alias("wsse"), F.lit(None).cast("double").alias("silhouette"))
    )
