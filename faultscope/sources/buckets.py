"""Tables in buckets with versions: a batch rewrites only the buckets that its rows fall in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.session import cut_lineage


def bucket_of(keys: Iterable[str | Column], buckets: int) -> Column:
    """Bucket of a row, from its key columns; null keys have one as well."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class BucketTable:
    """Rows of ``schema`` below ``path``, dealt into ``buckets`` by ``keys``.

    Version v holds the whole new state of the buckets that batch v changed, and a small table says which these
    are. Readers take each bucket's newest version, so a batch costs the buckets it touches, whatever the others hold.
    A version counts once its list of buckets is there, which is written last; a retried batch reads the versions before its own and
    replaces what it wrote the first time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def bucket(self) -> Column:
        return bucket_of(self.keys, self.buckets)

    def newest(self, before: int | None = None) -> dict[int, int]:
        """Newest version of each bucket, of those before a version; one small row per bucket is collected."""
        try:
            listed = self.spark.read.schema("bucket int, version bigint, held boolean").parquet(f"{self.path}/list")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            listed = listed.filter(F.col("version") < before)
        rows = listed.groupBy("bucket").agg(F.max(F.struct("version", "held")).alias("newest")).collect()
        return {r["bucket"]: r["newest"]["version"] for r in rows if r["newest"]["held"]}

    def read(self, buckets: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some, as they were before a version or are now."""
        newest = self.newest(before)
        wanted = sorted(newest if buckets is None else set(buckets) & set(newest))
        return _read(self.spark, [f"{self.path}/data/version={newest[b]}/bucket={b}" for b in wanted], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows with the key columns fall in; at most ``buckets`` numbers."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def write(self, rows: DataFrame, buckets: list[int], version: int) -> None:
        """The new state of these buckets: all their rows, and none where there are none."""
        data = cut_lineage(rows.withColumn("bucket", self.bucket()).repartition("bucket"))
        held = {r[0] for r in data.select("bucket").distinct().collect()}
        if held:
            data.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        listed = [(b, version, b in held) for b in sorted({*buckets, *held})]
        listed = self.spark.createDataFrame(listed, "bucket int, version bigint, held boolean")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/at={version}")
