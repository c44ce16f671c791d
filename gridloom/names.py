"""Names for helper columns that clash with no column of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names that start with the wanted ones and clash with no column of df, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
