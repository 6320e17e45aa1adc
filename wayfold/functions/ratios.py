"""Guarded ratios used as derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.model import require_columns


def guarded(top: str, bottom: str, otherwise: float) -> Column:
    """``top / bottom`` where ``bottom`` is positive, else ``otherwise``."""
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(otherwise))


# Name, numerator, denominator, value without a denominator, columns that must also be there.
ENTITY_RATIOS = (
    ("d_progress_ratio", "s_steps_done", "s_sys_node_count", 0.0, ()),
    ("d_wait_trend", "s_cum_wait", "s_elapsed", 0.0, ()),
    ("d_util_relative", "s_node_util", "s_sys_util", 1.0, ("s_node_avg_queue",)),
    ("d_cost_rate", "s_cum_cost", "s_elapsed", 0.0, ()),
)


def entity_ratios(columns: list[str], skip: tuple[str, ...] = ()) -> dict[str, Column]:
    """The entity ratios whose inputs are all present."""
    return {
        name: guarded(top, bottom, otherwise)
        for name, top, bottom, otherwise, also in ENTITY_RATIOS
        if name not in skip and {top, bottom, *also} <= set(columns)
    }


def queue_to_busy() -> Column:
    return guarded("in_queue", "busy", 0.0)


def imbalance(columns: list[str]) -> Column:
    """Largest over mean of the non-null values; 1 where the mean is not positive."""
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    mean = total / F.nullif(sum(present, F.lit(0)), F.lit(0))
    largest = F.greatest(*[F.col(c).cast("double") for c in columns])
    return F.when(mean > 0, largest / mean).otherwise(F.lit(1.0))


def node_columns(columns: list[str], metric: str) -> list[str]:
    return [c for c in columns if c.startswith("n_") and c.endswith(f"_{metric}")]


def observation_vector(df: DataFrame, names: list[str], at_least_one: bool = True) -> Column:
    """A fixed-order ARRAY<FLOAT>; a missing column or null becomes 0."""
    if at_least_one and not set(names) & set(df.columns):
        require_columns(df, *names)
    return F.array(
        *[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) if n in df.columns else F.lit(0.0).cast("float") for n in names]
    )
