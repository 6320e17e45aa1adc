"""Which columns may become features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayfold.model import (
    ENTITY_STATE,
    IDENTIFIER_COLUMNS,
    NODE_STATE,
    OUTCOME_COLUMNS,
    STRUCTURAL_SERIES_COLUMNS,
    SYSTEM_STATE,
    numeric_columns,
    require_columns,
)


def series_sources(
    df: DataFrame, target: str, columns: list[str] | None = None, exclude: list[str] | None = None
) -> list[str]:
    """The named columns that exist, or every numeric one, without target, time and bucket number."""
    if columns:
        return [c for c in columns if c != target and c in df.columns]
    left_out = {target, *STRUCTURAL_SERIES_COLUMNS, *(exclude or [])}
    return [c for c in numeric_columns(df) if c not in left_out]


def leaks(column: str) -> bool:
    """True for columns that tell the outcome or set its limit."""
    return column in OUTCOME_COLUMNS or column.startswith("sla_")


def entity_features(
    df: DataFrame,
    target: str,
    columns: list[str] | None = None,
    exclude: list[str] | None = None,
    entity_state: bool = True,
    node_state: bool = True,
    system_state: bool = True,
) -> list[str]:
    """Numeric state columns by group plus resource and attribute columns; never one that leaks the outcome."""
    if columns:
        leaking = [c for c in columns if leaks(c)]
        if leaking:
            raise ValueError(f"these columns tell the outcome and cannot be features: {leaking}")
        require_columns(df, *columns)
        candidates = list(columns)
    else:
        groups = ((entity_state, ENTITY_STATE), (node_state, NODE_STATE), (system_state, SYSTEM_STATE))
        candidates = [c for wanted, group in groups if wanted for c in group]
        candidates += [c for c in df.columns if c.startswith(("s_r_", "s_attr_"))]
    left_out = {target, *IDENTIFIER_COLUMNS, *OUTCOME_COLUMNS, *(exclude or [])}
    numeric = set(numeric_columns(df))
    return [c for c in candidates if c in numeric and c not in left_out and not leaks(c)]
