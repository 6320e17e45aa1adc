"""Which steps of an entity become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.model import UNKNOWN

POINTS = ("all_steps", "entry_only", "midpoint")


def observe(trajectories: DataFrame, point: str = "all_steps", tie: str = "half_up", nearest: bool = False) -> DataFrame:
    """Keep all steps, each entity's entry step, or its midpoint step.

    The midpoint is half the entity's largest step, rounded ``half_up`` or ``half_even``.
    An entity without exactly that step is left out unless ``nearest`` is set.
    """
    if point not in POINTS:
        raise ValueError(f"unknown observation point {point!r}; known: {list(POINTS)}")
    if point == "all_steps":
        return trajectories
    if point == "entry_only":
        return trajectories.filter(F.col("step") == 0)
    half = F.max("step") / 2
    middle = (F.round(half) if tie == "half_up" else F.bround(half)).cast("bigint")
    if nearest:
        closest = trajectories.groupBy("eid").agg(middle.alias("_middle"), F.max("step").alias("last_step"))
        steps = _closest_steps(trajectories, closest)
    else:
        steps = trajectories.groupBy("eid").agg(middle.alias("step"))
    # (eid, step) is unique, so this join spreads evenly even if one entity holds most rows.
    return trajectories.join(steps, ["eid", "step"], "left_semi")


def _closest_steps(trajectories: DataFrame, closest: DataFrame) -> DataFrame:
    from wayfold.operators.labels import spread

    apart = F.abs(F.col("step") - F.col("_middle"))
    return (
        spread(trajectories.select("eid", "step"), closest, "_middle")
        .groupBy("eid")
        .agg(F.min_by("step", F.struct(apart, F.col("step"))).alias("step"))
    )


def drop_unknown(df: DataFrame, label: str) -> DataFrame:
    """Leave out rows whose outcome never became known."""
    return df.filter(F.col(label) != UNKNOWN)
