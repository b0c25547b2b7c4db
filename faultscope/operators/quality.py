"""Checks of keys, choices and references; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The unique keys, choices and references of the stored tables.
UNIQUE_KEYS = {
    "issue_category": [["regex"]],
    "transfer_issue": [["message", "type"]],
    "site_pair": [["src_site", "dst_site"]],
    "issue_metadata": [["issue_id", "key", "value"]],
    "action": [["action"]],
    "label_archive": [["name"]],
}
CHOICES = {
    ("transfer_issue", "status"): ["New", "Ongoing", "Resolved"],
    ("solution", "affected_site"): ["src_site", "dst_site", "unknown"],
}
REFERENCES = [
    ("transfer_issue", "category", "issue_category"),
    ("transfer_issue", "solution", "solution"),
    ("transfer_issue", "action", "action"),
    ("solution", "solution", "action"),
    ("issue_metadata", "issue_id", "transfer_issue"),
    ("workflow_issue", "session_id", "sessions"),
    ("workflow_issue_metadata", "issue_id", "workflow_issue"),
    ("workflow_issue_ticks", "issue_id", "workflow_issue"),
]

# The column that references to a table are made to.
PRIMARY_KEYS = {
    "issue_category": "id",
    "transfer_issue": "id",
    "solution": "id",
    "action": "id",
    "sessions": "session_id",
    "workflow_issue": "issue_id",
}


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared key, choice and reference of the given tables:
    ``kind, table, columns, n_violations`` (values that repeat or lie outside, rows without a parent).

    Constraints on tables or columns that are not given are left out.
    """
    found = []

    def add(kind: str, name: str, columns: str, violations: DataFrame) -> None:
        count = violations.agg(F.count("*").alias("n_violations"))
        found.append(count.select(F.lit(kind).alias("kind"), F.lit(name).alias("table"), F.lit(columns).alias("columns"), "n_violations"))

    def has(name: str, *columns: str) -> bool:
        return name in tables and set(columns) <= set(tables[name].columns)

    for name, keys in UNIQUE_KEYS.items():
        for key in keys:
            if has(name, *key):
                add("key", name, ",".join(key), key_violations(tables[name], key))
    for (name, column), choices in CHOICES.items():
        if has(name, column):
            add("choice", name, column, choice_violations(tables[name], column, choices))
    for name, reference, parent in REFERENCES:
        if has(name, reference) and has(parent, PRIMARY_KEYS[parent]):
            add("reference", name, reference, orphans(tables[name], reference, tables[parent], PRIMARY_KEYS[parent]))
    if not found:
        raise ValueError("no declared constraint is on the given tables")
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total


def key_violations(table: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return table.groupBy(*key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def choice_violations(table: DataFrame, column: str, choices: list[str]) -> DataFrame:
    """Values outside the list of choices, with their number of rows."""
    outside = table.filter(~F.col(column).isin(choices))
    return outside.groupBy(column).agg(F.count("*").alias("n_rows"))


def orphans(child: DataFrame, reference: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is set but has no parent."""
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    return child.filter(F.col(reference).isNotNull()).join(
        known, F.col(reference) == F.col("_known"), "left_anti"
    )
