"""Column names that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def private(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name
