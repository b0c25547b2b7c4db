"""Search in stored issues: an index of three-letter grams for parts of messages, and pages by their first key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultscope.operators.patterns import full_rank
from faultscope.operators.transfers import PAGE_SIZE, filter_issues, sort_order
from faultscope.sources.stores import read_or_empty

GRAM = 3
# So many of the rarest grams of what is looked for are read; each match is verified anyway.
RAREST = 4
# Grams of more than one text in so many are not listed with their texts, if there are as many texts as that at all: where a part has no other
# gram, looking at each distinct text costs less than those lists.
COMMON = 16
MANY = 10_000
PARTS = {"grams": "text_id bigint, gram string, bucket int", "counts": "gram string, n bigint, listed boolean, bucket int"}


# Three characters from each place on; a place within a surrogate pair has none.
ANY_GRAM = r"(?=([\x{0}-\x{d7ff}\x{e000}-\x{10ffff}]{%d}))" % GRAM


def _grams(text: Column) -> Column:
    """The distinct grams of a text, none if it is shorter."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.regexp_extract_all(text, F.lit(ANY_GRAM), F.lit(1))))


class IssueIndex:
    """Issues (``id, message`` and more) stored below ``path`` with an index of their messages, any case.

    Equal messages are one text, whose number is the smallest id. Grams that few texts hold lie in ``buckets`` partitions, sorted, so a search reads
    the buckets of its rarest grams only, and of these the row groups that can hold them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def build(self, issues: DataFrame) -> None:
        """Store issues and index; issues without message are found by their other columns only."""
        lower = issues.withColumn("_lower", F.lower("message"))
        texts = lower.filter("_lower IS NOT NULL").groupBy(F.col("_lower").alias("text")).agg(F.min("id").cast("bigint").alias("text_id"))
        texts.write.mode("overwrite").parquet(f"{self.path}/texts")
        texts = self._table("texts")
        joined = lower.join(texts, F.col("_lower") == F.col("text"), "left").drop("_lower", "text")
        joined.write.mode("overwrite").parquet(f"{self.path}/issues")
        grams = texts.select("text_id", F.explode(_grams(F.col("text"))).alias("gram"))
        # Counts per gram collapse map-side; a gram that all texts hold is one row.
        listed = F.col("n") <= max(MANY, texts.count() // COMMON)
        counts = grams.groupBy("gram").agg(F.count("*").alias("n")).select("gram", "n", listed.alias("listed"), self._bucket(F.col("gram")).alias("bucket"))
        self._write(counts.repartition("bucket"), "counts")
        # At most COMMON times as many as a text has grams.
        common = self._table("counts").filter("NOT listed").select(F.col("gram").alias("_common"))
        rare = grams.join(common, F.col("gram") == F.col("_common"), "left_anti").withColumn("bucket", self._bucket(F.col("gram")))
        self._write(rare.repartition("bucket", F.pmod("text_id", F.lit(8))), "grams")

    def matching_texts(self, part: str) -> DataFrame:
        """(text_id) of the texts that contain ``part``, in any case."""
        texts = self._table("texts")
        sought = self.spark.range(1).select(F.lower(F.lit(part)).alias("part")).withColumn("grams", _grams(F.col("part"))).first()
        verified = F.contains("text", F.lit(sought["part"]))
        if sought["grams"] is None:
            # Too short for a gram: each distinct text is looked at.
            return texts.filter(verified).select("text_id")
        # At most as many rows as the part has letters.
        counts = self._of_grams("counts", sought["grams"]).collect()
        if len(counts) < len(sought["grams"]):
            return texts.limit(0).select("text_id")
        rare = [r["gram"] for r in sorted(counts, key=lambda r: (r["n"], r["gram"])) if r["listed"]][:RAREST]
        if not rare:
            # Every gram is in many texts.
            return texts.filter(verified).select("text_id")
        held = self._of_grams("grams", rare).groupBy("text_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare))
        return texts.join(held, "text_id", "left_semi").filter(verified).select("text_id")

    def search(self, issue_id: int | None = None, message: str | None = None, categories: list[int] | str | None = None) -> DataFrame:
        """Issues by id, part of the message and categories, in no order; ``page_bounds`` and ``page`` sort them."""
        issues = filter_issues(self._table("issues"), issue_id, categories)
        if message is not None:
            issues = issues.join(self.matching_texts(message), "text_id", "left_semi")
        return issues.drop("text_id")

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _of_grams(self, name: str, grams: list[str]) -> DataFrame:
        """Rows of these grams; their buckets are partitions, which the filter prunes."""
        listed = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = [r[0] for r in listed.select(self._bucket(F.col("gram"))).distinct().collect()]
        return self._table(name).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def _table(self, name: str) -> DataFrame:
        if name in PARTS:
            # An empty table has no file to tell its columns.
            return read_or_empty(self.spark, f"{self.path}/{name}", PARTS[name])
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")


# -- pages ----------------------------------------------------------------------------------


def page_bounds(found: DataFrame, order_by: str = "id", page_size: int = PAGE_SIZE) -> DataFrame:
    """(page, value, id) of the first issue of each page; the issues are numbered in slices, none goes through the driver."""
    column = order_by.lstrip("-")
    # Descending order is that of the same two columns.
    order = sort_order(order_by)
    keys = found.select(F.lit(0).alias("_all"), *dict.fromkeys([column, "id"]))
    numbered = full_rank(keys, "_all", order, "_place")
    first = numbered.filter((F.col("_place") - 1) % page_size == 0)
    number = ((F.col("_place") - 1) / page_size + 1).cast("bigint")
    return first.select(number.alias("page"), F.col(column).alias("value"), "id")


def page(found: DataFrame, bounds: DataFrame, number: int, order_by: str = "id", page_size: int = PAGE_SIZE) -> DataFrame:
    """A page by its first key: what lies before it is filtered out, not counted off. Pages that aren't there are empty."""
    start = bounds.filter(F.col("page") == number).select("value", "id").first()
    if start is None:
        return found.limit(0)
    return _from(found, start["value"], start["id"], order_by, True).orderBy(*sort_order(order_by)).limit(page_size)


def next_page(found: DataFrame, value, issue_id: int, order_by: str = "id", page_size: int = PAGE_SIZE) -> DataFrame:
    """The page after an issue, given by its id and its value in the column of the order."""
    return _from(found, value, issue_id, order_by, False).orderBy(*sort_order(order_by)).limit(page_size)


def _from(found: DataFrame, value, issue_id: int, order_by: str, inclusive: bool) -> DataFrame:
    """Issues from a place in the order on; nulls are the smallest values there."""
    column = F.col(order_by.lstrip("-"))
    here = F.col("id") >= issue_id if inclusive else F.col("id") > issue_id
    descending = order_by.startswith("-")
    if value is None:
        same, behind = column.isNull(), F.lit(False) if descending else column.isNotNull()
    else:
        same = column == F.lit(value)
        behind = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
    return found.filter((same & here) | behind)
