"""Names for helper columns that no column of a user's table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found
