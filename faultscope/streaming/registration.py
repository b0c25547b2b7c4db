"""Registering issues batch by batch, against a stored index of all categories.

A batch is compared with those stored categories alone that share a rare gram with one of its messages. The index
is a table of (gram key, category) in partitions of the key; the order that makes a gram rare is fixed by the first batch,
as any fixed order finds every similar text. Issues and categories lie in buckets of which a batch rewrites those it touches.
So a batch costs its own size and what it meets, and the store is never clustered again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultscope.functions import similarity as sim
from faultscope.operators import similarity as sml
from faultscope.operators import transfers as tra
from faultscope.plans.issue_registration import CATEGORY_SCHEMA, ISSUE_SCHEMA
from faultscope.session import cut_lineage
from faultscope.sources.buckets import BucketTable
from faultscope.sources.files import TRANSFER_LOG
from faultscope.streaming.windows import stream_files

INDEX_SCHEMA = "key bigint, id bigint, n_chars int, home int, part int, version bigint"
PARTS = 64
# Bits of a message's place within its batch; the batch's number stands above.
ARRIVAL_BITS = 40


class CategoryStore:
    """Issues, categories and the gram index of the categories below one folder."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = sml.MIN_SIMILARITY, buckets: int = 64):
        self.spark, self.path, self.threshold = spark, path, threshold
        self.issues = BucketTable(spark, f"{path}/issues", ISSUE_SCHEMA, tra.ISSUE_KEY, buckets)
        self.categories = BucketTable(spark, f"{path}/categories", CATEGORY_SCHEMA, ["regex"], buckets)

    # -- the gram index

    def gram_order(self, texts: DataFrame) -> np.ndarray:
        """Occurrences per gram bucket that the index was begun with; the first texts set them."""
        try:
            rows = self.spark.read.schema("bucket bigint, n bigint").parquet(f"{self.path}/grams").toPandas()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            frequency = sml.gram_frequency(texts)
            held = np.nonzero(frequency)[0]
            counted = [(int(b), int(frequency[b])) for b in held]
            self.spark.createDataFrame(counted, "bucket bigint, n bigint").coalesce(1).write.parquet(f"{self.path}/grams")
            return frequency
        frequency = np.zeros(sim.GRAM_BUCKETS, dtype=np.int64)
        frequency[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return frequency

    def keys(self, texts: DataFrame, frequency: np.ndarray) -> DataFrame:
        """(key, id, n_chars) of texts (id, text): their rarest grams, and one key below 0 that only equal texts share."""
        grams = sml.gram_groups(texts, frequency, self.threshold, "ratio")
        whole = texts.select((-F.shiftrightunsigned(F.xxhash64("text"), 2) - 1).alias("key"), "id")
        sizes = texts.select(F.col("id").alias("_id"), F.length("text").alias("n_chars"))
        return grams.unionByName(whole).join(sizes, F.col("id") == F.col("_id")).drop("_id")

    def index_rows(self, parts: list[int], before: int) -> DataFrame:
        """The index of all categories founded before a batch, in some partitions of the key."""
        try:
            index = self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.path}/index")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            index = self.spark.createDataFrame([], INDEX_SCHEMA)
        return index.filter(F.col("part").isin(parts) & (F.col("version") < before))

    def lookup(self, texts: DataFrame, keys: DataFrame, before: int) -> DataFrame:
        """Best stored category of each text, if any is above the threshold: text, regex, similarity, _order (its id)."""
        part = F.pmod("key", F.lit(PARTS)).cast("int")
        parts = [r[0] for r in keys.select(part).distinct().collect()]
        index = self.index_rows(parts, before).select("key", F.col("id").alias("category"), F.col("n_chars").alias("size"), "home")
        sizes = keys.select(F.col("key").alias("_key"), "n_chars").distinct()
        # Texts that are similar above t differ in length by the factor (2 - t) / t at most.
        factor = (2 - self.threshold) / self.threshold
        fits = F.greatest("n_chars", "size") <= F.least("n_chars", "size") * factor
        # A category that shares a key is there once per key, however many texts have it.
        met = cut_lineage(index.join(sizes, (F.col("key") == F.col("_key")) & fits, "left_semi"))
        homes = [r[0] for r in met.select("home").distinct().collect()]
        ids = met.select("category").distinct()
        known = self.categories.read(homes, before).select("id", F.col("regex").alias("text"))
        known = cut_lineage(known.join(ids, known["id"] == ids["category"], "left_semi"))
        named = known.select(F.col("id").alias("category"), F.col("text").alias("regex"))
        equal = texts.join(named, F.col("text") == F.col("regex")).select("text", "regex", F.lit(1.0).alias("similarity"), F.col("category").alias("_order"))
        rest = cut_lineage(texts.join(named, F.col("text") == F.col("regex"), "left_anti"))
        grams = [rows.filter("key >= 0").select("key", F.col(c).alias("id")).distinct() for rows, c in ((keys, "id"), (met, "category"))]
        grams[0] = grams[0].join(rest.select("id"), "id", "left_semi")
        groups = sml.cheaper(tuple(grams), sml.by_length(rest, known, self.threshold, "ratio"))
        best = sml.best_matches(rest, known, self.threshold, "ratio", groups=groups)
        best = best.join(rest.select(F.col("id").alias("left_id"), "text"), "left_id").join(
            named.withColumnRenamed("category", "right_id"), "right_id"
        )
        return equal.unionByName(best.select("text", "regex", "similarity", F.col("right_id").alias("_order")))

    # -- a batch

    def register(self, incoming: DataFrame, batch: int, now: Column) -> None:
        """Take in the issues of a batch: the issue key, ``amount``, and ``id`` in order of arrival.

        New issues come in, known ones keep their amount and get a new time. Each message of the batch joins the most similar
        category that exists when it arrives, which grows by its issues' amounts, or founds one.
        """
        key = tra.ISSUE_KEY
        incoming = cut_lineage(incoming.select(*key, "amount", "id"))
        buckets = self.issues.touched(incoming)
        stored = cut_lineage(self.issues.read(buckets, batch))
        under = [F.col(c).alias(f"_{c}") for c in key]
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        ids = incoming.groupBy(*under).agg(F.min("id").alias("id"))
        table = tra.upsert_issues(stored.drop("category"), incoming, now).join(ids, same, "left").drop(*[f"_{c}" for c in key])
        table = cut_lineage(table)
        arrived = table.filter("id is not null").groupBy("message").agg(F.min("id").alias("id"), F.sum("amount").alias("amount"))
        arrived = cut_lineage(arrived)

        texts = cut_lineage(sml.distinct_texts(arrived, "message", "id"))
        frequency = self.gram_order(texts)
        keys = cut_lineage(self.keys(texts, frequency))
        offers = cut_lineage(self.lookup(texts, keys, batch))
        assigned, grown = sml.categorise_issues(arrived, threshold=self.threshold, offers=offers)
        known = offers.groupBy("regex").agg(F.min("_order").alias("_known"))
        founders = texts.select(F.col("text").alias("_text"), F.col("id").alias("_founder"))
        grown = grown.join(known, "regex", "left").join(founders, F.col("regex") == F.col("_text"), "left")
        grown = cut_lineage(grown.select(F.coalesce("_known", "_founder").alias("id"), "regex", "amount", F.col("_known").isNull().alias("new")))
        self._write(table, stored, assigned, grown, keys, buckets, batch)

    def _write(self, table: DataFrame, stored: DataFrame, assigned: DataFrame, grown: DataFrame, keys: DataFrame, buckets: list[int], batch: int) -> None:
        key = tra.ISSUE_KEY
        # The index first and the issues last: what a batch that breaks off leaves is replaced when it is tried again.
        new = grown.filter("new").select(F.col("id").alias("_id"), self.categories.bucket().alias("home"))
        founded = keys.join(new, F.col("id") == F.col("_id")).select(
            "key", "id", "n_chars", "home", F.pmod("key", F.lit(PARTS)).cast("int").alias("part")
        )
        founded.repartition("part").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(
            f"{self.path}/index/version={batch}"
        )
        homes = self.categories.touched(grown)
        rows = self.categories.read(homes, batch).unionByName(grown.select("id", "regex", "amount"))
        self.categories.write(rows.groupBy("regex").agg(F.min("id").alias("id"), F.sum("amount").alias("amount")).select("id", "regex", "amount"), homes, batch)
        chosen = assigned.select(F.col("message").alias("_said"), F.col("category").alias("_new"))
        old = stored.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("category").alias("_old"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        table = table.join(old, same, "left").drop(*[f"_{c}" for c in key]).join(chosen, F.col("message") == F.col("_said"), "left")
        category = F.when(F.col("id").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
        self.issues.write(table.select(*key, "amount", "last_modified", category.alias("category")), buckets, batch)


def in_order(issues: DataFrame, arrivals: DataFrame, batch: int) -> DataFrame:
    """Issues with ``id``: the first ``arrival`` (message, arrival; below 2^40) of their message, after all earlier batches."""
    first = arrivals.groupBy(F.col("message").alias("_message")).agg(F.min("arrival").alias("_arrival"))
    place = F.coalesce("_arrival", F.lit(0)) + F.lit(batch << ARRIVAL_BITS)
    joined = issues.join(first, F.col("message") == F.col("_message"), "left")
    return joined.select(*issues.columns, place.alias("id"))


def register_stream(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    issues_of: Callable[[DataFrame], DataFrame],
    arrival: str,
    message: str = "t__error_message",
    now: Callable[[int], Column] = lambda batch: F.current_timestamp(),
    schema: T.StructType = TRANSFER_LOG,
    threshold: float = sml.MIN_SIMILARITY,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Register the issues of the JSON files that arrive in a folder, one batch after the other.

    ``issues_of`` turns the flat log of a batch into issues. ``arrival`` is the log's column that says which of a batch's messages
    came first. All files present now are read, then the query stops, unless a trigger is given.
    """
    store = CategoryStore(spark, path, threshold)

    def take(batch: DataFrame, number: int) -> None:
        log = cut_lineage(batch.select("data.*"))
        arrivals = log.select(F.col(message).alias("message"), F.col(arrival).cast("bigint").alias("arrival"))
        store.register(in_order(issues_of(log), arrivals, number), number, now(number))

    stream = stream_files(spark, folder, schema, "json", **options)
    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def registered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The issue table and the category table as the batches so far have left them."""
    store = CategoryStore(spark, path)
    return store.issues.read(), store.categories.read()
