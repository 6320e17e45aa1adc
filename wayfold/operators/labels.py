"""Outcome labels per entity, spread over all of its steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.model import DERIVED_LABELS, PREFERRED_LIMITS, UNKNOWN, require_columns
from wayfold.operators.quantile import quantiles
from wayfold.session import cut_lineage

STEPS_PER_BLOCK = 100_000


def limit_column(columns: list[str]) -> str | None:
    """The deadline column to use when none is named: a preferred one, else the first ``sla_*``."""
    candidates = sorted(c for c in columns if c.startswith("sla_"))
    return next((c for c in PREFERRED_LIMITS if c in candidates), candidates[0] if candidates else None)


def final_values(trajectories: DataFrame, *columns: str) -> DataFrame:
    """One row per entity: its last step, whether it completed, and ``columns`` at its last completed step.

    A single aggregation, combined map-side, so a hot entity costs no more than its partial rows.
    """
    require_columns(trajectories, "eid", "step", "done")
    done_step = F.when(F.col("done"), F.col("step"))
    return trajectories.groupBy("eid").agg(
        F.max("step").alias("last_step"),
        F.coalesce(F.max("done"), F.lit(False)).alias("completed"),
        *[F.max_by(c, done_step).alias(c) for c in columns],
    )


def spread(
    trajectories: DataFrame, per_entity: DataFrame, *columns: str, steps_per_block: int = STEPS_PER_BLOCK,
    last_step: int | None = None,
) -> DataFrame:
    """Join per-entity ``columns`` back to every step.

    The join key is (entity, block of steps): the entity side is repeated once per
    block of a long run, so one hot entity spreads over many tasks. If ``last_step``
    tells that every run fits one block, the entity alone is the key, which reuses a
    partitioning by entity.
    """
    if last_step is not None and last_step < steps_per_block:
        return trajectories.join(per_entity.select("eid", *columns), "eid", "left").select(*trajectories.columns, *columns)

    def block(step: Column) -> Column:
        return F.floor(F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)) / steps_per_block)

    right = per_entity.select(
        F.col("eid"), *columns, F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col("last_step")))).alias("_steps")
    )
    left = trajectories.withColumn("_steps", block(F.col("step")))
    return left.join(right, ["eid", "_steps"], "left").select(*trajectories.columns, *columns)


def _labelled(
    trajectories: DataFrame, outcomes: DataFrame, name: str, label: Column, last_step: int | None = None
) -> DataFrame:
    labels = outcomes.select("eid", "last_step", F.when(F.col("completed"), label).alias(name))
    known = spread(trajectories.drop(name), labels, name, last_step=last_step)
    return known.withColumn(name, F.coalesce(F.col(name), F.lit(UNKNOWN)))


def _breach(over: Column) -> Column:
    return F.when(over, F.lit("breach")).otherwise(F.lit("no_breach"))


def sla_breach(
    trajectories: DataFrame,
    limit: str | None = None,
    threshold: float | None = None,
    fraction: float = 0.75,
    method: str = "nearest",
) -> DataFrame:
    """``breach`` where a completed entity took longer than allowed, else ``no_breach``.

    Allowed is ``threshold``, else the entity's own ``limit`` column, else the column
    found by :func:`limit_column`, else the ``fraction`` quantile of all completed times.
    """
    require_columns(trajectories, "eid")
    require_columns(trajectories, "total_time")
    if threshold is None:
        column = limit if limit in trajectories.columns else limit_column(trajectories.columns)
        if column is not None:
            outcomes = final_values(trajectories, "total_time", column)
            return _labelled(trajectories, outcomes, "sla_breach", _breach(F.col("total_time") > F.col(column)))
        threshold = quantiles(trajectories.filter("done"), "total_time", [fraction], method)[0]
    slowest = trajectories.groupBy("eid").agg(
        F.max("step").alias("last_step"),
        F.coalesce(F.max("done"), F.lit(False)).alias("completed"),
        F.max(F.when(F.col("done"), F.col("total_time"))).alias("total_time"),
    )
    over = F.col("total_time") > F.lit(threshold).cast("double")
    return _labelled(trajectories, slowest, "sla_breach", _breach(over))


def delay_severity(
    trajectories: DataFrame,
    fractions: tuple[float, ...] = (0.33, 0.66),
    names: tuple[str, ...] = ("on_time", "minor_delay", "major_delay"),
    method: str = "nearest",
) -> DataFrame:
    """Classes of the share of an entity's total time spent waiting, cut at quantiles over completed entities."""
    if len(names) != len(fractions) + 1:
        raise ValueError("one more class name than cut points is needed")
    require_columns(trajectories, "eid", "total_time", "s_cum_wait")
    share = F.when(F.col("total_time") > 0, F.col("s_cum_wait") / F.col("total_time")).otherwise(F.lit(0.0))
    outcomes = final_values(trajectories, "total_time", "s_cum_wait").withColumn(
        "share", F.when(F.col("completed"), share)
    )
    # Three passes need the one-row-per-entity table; written once, it is aggregated once.
    outcomes = cut_lineage(outcomes.select("eid", "last_step", "completed", "share"), "outcomes")
    cuts = quantiles(outcomes, "share", list(fractions), method)
    longest = outcomes.agg(F.max("last_step").alias("last")).first()["last"]
    return _labelled(trajectories, outcomes, "delay_severity", _classes(F.col("share"), cuts, names), longest)


def wait_ratio_class(
    trajectories: DataFrame,
    cuts: tuple[float, ...] = (0.3, 0.6),
    names: tuple[str, ...] = ("efficient", "moderate", "congested"),
) -> DataFrame:
    """Classes of waiting / (waiting + processing) at fixed cut points, comparable between datasets."""
    if len(names) != len(cuts) + 1:
        raise ValueError("one more class name than cut points is needed")
    require_columns(trajectories, "eid", "s_cum_wait", "s_cum_processing")
    busy = F.col("s_cum_wait") + F.col("s_cum_processing")
    ratio = F.when(busy > 0, F.col("s_cum_wait") / busy).otherwise(F.lit(0.0))
    outcomes = final_values(trajectories, "s_cum_wait", "s_cum_processing")
    return _labelled(trajectories, outcomes, "wait_ratio_class", _classes(ratio, list(cuts), names))


def _classes(value: Column, cuts: list[float | None], names: tuple[str, ...]) -> Column:
    # A null value passes every comparison by and so lands in the last class.
    branch = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        branch = F.when(value <= F.lit(cut).cast("double"), F.lit(name)).otherwise(branch)
    return branch


LABELS: dict[str, Callable[..., DataFrame]] = {
    "sla_breach": sla_breach,
    "delay_severity": delay_severity,
    "wait_ratio_class": wait_ratio_class,
}


def derive(trajectories: DataFrame, target: str, **options: object) -> DataFrame:
    """Add the derived label ``target``."""
    if target not in LABELS:
        raise ValueError(f"unknown label {target!r}; known: {sorted(DERIVED_LABELS)}")
    return LABELS[target](trajectories, **options)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per label, largest first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return counts.withColumn("percent", F.round(F.col("rows") / total * 100, 6)).orderBy(F.desc("rows"), F.asc(label))
