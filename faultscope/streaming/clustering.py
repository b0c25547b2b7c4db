"""Clusters that follow a stream of vectors: mini-batch K-Means on a table of centroids with versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultscope.operators import clustering as clu
from faultscope.session import cut_lineage

CENTERS_SCHEMA = "cluster int, centroid array<double>, size double"


@dataclass(frozen=True)
class FollowSettings:
    """``decay`` is what a batch leaves of the earlier weight of each centroid; up to ``new_clusters`` open per batch."""

    threshold: float
    new_clusters: int = 1
    decay: float = 1.0
    distance: str = "cosine"


class CentroidStore:
    """The centroids after each batch, and the clusters that each batch's vectors got, below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, before: int | None = None) -> DataFrame:
        """The newest centroids, or the newest of those before a version; none if there are none."""
        try:
            versions = self.spark.read.schema(f"{CENTERS_SCHEMA}, version bigint").parquet(f"{self.path}/centroids")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], CENTERS_SCHEMA)
        if before is not None:
            versions = versions.filter(F.col("version") < before)
        newest = versions.agg(F.max("version")).first()[0]
        return versions.filter(F.col("version") == F.lit(newest)).drop("version")

    def write(self, centers: DataFrame, version: int) -> None:
        """Replace a version; the start is version -1."""
        rows = centers.select("cluster", "centroid", F.col("size").cast("double").alias("size"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids/version={version}")

    def predictions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/predictions")


def opened_centers(vectors: DataFrame, centers: DataFrame, id_col: str, vector_col: str, settings: FollowSettings) -> DataFrame:
    """The centroids and those of new clusters, of weight 0: the vector farthest from all of them, one after the other,
    as long as it is beyond the threshold. Equally far ones come by id."""
    for _ in range(settings.new_clusters):
        near = clu.nearest_centroid(vectors, centers, vector_col, settings.distance)
        first = centers.agg(F.max("cluster")).first()[0]
        beyond = F.col("distance") > settings.threshold
        if first is None:
            length = F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x * x)
            beyond = (length > 0) if settings.distance == "cosine" else F.lit(True)
        else:
            beyond &= F.col("cluster") != clu.NO_CLUSTER
        far = near.filter(beyond).agg(F.min_by(vector_col, F.struct(-F.coalesce("distance", F.lit(0.0)), F.col(id_col))).alias("centroid"))
        seed = far.first()["centroid"]
        if seed is None:
            break
        number = 0 if first is None else first + 1
        centers = centers.unionByName(vectors.sparkSession.createDataFrame([(number, list(seed), 0.0)], CENTERS_SCHEMA))
    return centers


def follow(vectors: DataFrame, centers: DataFrame, id_col: str, vector_col: str, settings: FollowSettings) -> tuple[DataFrame, DataFrame]:
    """One batch: (id, cluster, distance) of its vectors, and the centroids after it.

    New clusters open first. Each vector within the threshold moves the nearest centroid, which keeps ``decay`` of its weight; the new centroid
    is the weighted mean. Vectors beyond it, and zero vectors where only the direction counts, get cluster -1 and move nothing.
    """
    centers = cut_lineage(opened_centers(vectors, centers, id_col, vector_col, settings))
    near = cut_lineage(clu.nearest_centroid(vectors, centers, vector_col, settings.distance))
    within = (F.col("cluster") != clu.NO_CLUSTER) & (F.col("distance") <= settings.threshold)
    added = near.filter(within).groupBy(F.col("cluster").alias("_cluster")).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(vector_col)))).alias("_sum"), F.count("*").alias("_n")
    )
    weight = F.col("size") * settings.decay
    size = weight + F.coalesce("_n", F.lit(0))
    moved = F.zip_with("centroid", "_sum", lambda c, s: (c * weight + s) / size)
    after = centers.join(added, F.col("cluster") == F.col("_cluster"), "left").select(
        "cluster", F.when(F.col("_n").isNull(), F.col("centroid")).otherwise(moved).alias("centroid"), size.alias("size")
    )
    given = near.select(id_col, F.when(within, F.col("cluster")).otherwise(clu.NO_CLUSTER).alias("cluster"), "distance")
    return given, after


def follow_stream(
    vectors: DataFrame, path: str, checkpoint: str, id_col: str, vector_col: str, settings: FollowSettings, trigger: dict | None = None
) -> StreamingQuery:
    """Let the centroids stored below ``path`` follow a stream of vectors; batch n leaves version n.

    A batch starts from the newest version before its own and replaces what an earlier try of it wrote, so a retry changes nothing. By default all
    files present now are read, then the query stops.
    """
    store = CentroidStore(vectors.sparkSession, path)

    def take(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(batch.select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col)))
        given, after = follow(rows, store.read(number), id_col, vector_col, settings)
        given.write.mode("overwrite").parquet(f"{path}/predictions/batch={number}")
        store.write(after, number)

    return (
        vectors.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
