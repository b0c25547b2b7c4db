"""Registering issues: stored table, category and category amounts in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultscope.operators import similarity as sml
from faultscope.operators import transfers as tra
from faultscope.session import cut_lineage

ISSUE_SCHEMA = "message string, src_site string, dst_site string, type string, amount bigint, last_modified timestamp, category string"
CATEGORY_SCHEMA = "id bigint, regex string, amount bigint"


def register_issues(
    stored: DataFrame,
    categories: DataFrame,
    incoming: DataFrame,
    now: Column,
    threshold: float = sml.MIN_SIMILARITY,
) -> tuple[DataFrame, DataFrame]:
    """The issue table and the category table after ``incoming`` issues have arrived.

    ``stored`` has ``ISSUE_SCHEMA``, where ``category`` is the category's text, ``categories`` has
    ``CATEGORY_SCHEMA``; ``incoming`` has the issue key, ``amount``, and ``id`` in order of arrival, larger than
    the ids of all categories. New issues come in, known ones keep their amount and get a new time.
    Every issue that arrived joins the most similar category, which grows by the issue's amount,
    or its message founds one, which gets the id of the message's first arrival.
    """
    key = tra.ISSUE_KEY
    incoming = cut_lineage(incoming.select(*key, "amount", "id"))
    named = [F.col(c).alias(f"_{c}") for c in key]
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    under = [f"_{c}" for c in key]
    ids = incoming.groupBy(*named).agg(F.min("id").alias("id"))
    table = tra.upsert_issues(stored.drop("category"), incoming, now).join(ids, same, "left").drop(*under)
    table = cut_lineage(table)
    arrived = table.filter("id is not null").groupBy("message").agg(F.min("id").alias("id"), F.sum("amount").alias("amount"))
    arrived = cut_lineage(arrived)
    assigned, grown = sml.categorise_issues(arrived, categories, threshold=threshold)
    founders = arrived.select(F.col("message").alias("_text"), F.col("id").alias("_founder"))
    known = categories.select(F.col("regex").alias("_regex"), F.col("id").alias("_known"))
    grown = grown.join(known, F.col("regex") == F.col("_regex"), "left").join(founders, F.col("regex") == F.col("_text"), "left")
    grown = grown.select(F.coalesce("_known", "_founder").alias("id"), "regex", "amount")
    chosen = assigned.select(F.col("message").alias("_said"), F.col("category").alias("_new"))
    old = stored.select(*named, F.col("category").alias("_old"))
    table = table.join(old, same, "left").drop(*under).join(chosen, F.col("message") == F.col("_said"), "left")
    category = F.when(F.col("id").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return table.select(*key, "amount", "last_modified", category.alias("category")), grown
