"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many leading underscores as it takes to be no column of ``df``."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name
