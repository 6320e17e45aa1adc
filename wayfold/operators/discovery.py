"""Which columns can be predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.model import STRUCTURAL_SERIES_COLUMNS, text_columns
from wayfold.operators.profile import column_profile

SERIES_TARGET = "avg_wait"
ENTITY_TARGET = "status"


def series_targets(profile: DataFrame) -> DataFrame:
    """Numeric columns of a stored profile as regression targets; ``avg_wait``, else the first, is the default."""
    candidates = profile.where(F.col("is_numeric") & ~F.col("name").isin(*STRUCTURAL_SERIES_COLUMNS))
    names = [r["name"] for r in candidates.select("name").collect()]
    default = SERIES_TARGET if SERIES_TARGET in names else (names[0] if names else None)
    return candidates.select(
        F.col("name").alias("column"),
        F.lit("regression").alias("task"),
        (F.col("name") == F.lit(default)).alias("is_default"),
        "null_rate", "mean", "std", "min", "max", "unique_count",
    )


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(label, rows, share) over the non-null values."""
    named = df.select(F.col(column).cast("string").alias("label")).where(F.col("label").isNotNull())
    total = named.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "share", F.round(F.col("rows") / total, 6)
    )


def entity_targets(trajectories: DataFrame, max_listed: int = 1000) -> DataFrame:
    """Rows (column, task, is_default, null_rate, unique_count, classes) for what can be predicted per entity.

    ``status`` first, then labels that can be derived from the columns at hand; with
    neither, any text column. More than ``max_listed`` classes are counted but not listed.
    """
    columns = trajectories.columns
    parts = []
    if ENTITY_TARGET in columns:
        parts.append(_text_target(trajectories, ENTITY_TARGET, True, max_listed))
    if {"s_cum_wait", "total_time"} & set(columns):
        parts.append(_derived(trajectories, "sla_breach", ["no_breach", "breach"]))
    if "total_time" in columns:
        parts.append(_derived(trajectories, "delay_severity", ["on_time", "minor_delay", "major_delay"]))
    if not parts:
        names = text_columns(trajectories)
        parts = [_text_target(trajectories, c, i == 0, max_listed) for i, c in enumerate(names)]
    if not parts:
        return trajectories.sparkSession.createDataFrame([], _TARGET_SCHEMA)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


_TARGET_SCHEMA = (
    "column string, task string, is_default boolean, null_rate double, unique_count bigint, classes array<string>"
)


def _text_target(df: DataFrame, column: str, default: bool, max_listed: int) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    # Only the first labels by name can be listed, so no group holds more than that many.
    listed = counts.where(F.col("label").isNotNull()).orderBy("label").limit(max_listed + 1)
    classes = listed.agg(F.array_sort(F.collect_list("label")).alias("c")).select("c").scalar()
    return counts.agg(
        F.lit(column).alias("column"),
        F.lit("classification").alias("task"),
        F.lit(default).alias("is_default"),
        F.coalesce(
            F.round(F.try_divide(F.sum(F.when(F.col("label").isNull(), F.col("rows")).otherwise(0)), F.sum("rows")), 6),
            F.lit(0.0),
        ).alias("null_rate"),
        F.count("label").alias("unique_count"),
    ).withColumn("classes", F.when(F.col("unique_count") <= max_listed, classes))


def _derived(df: DataFrame, name: str, classes: list[str]) -> DataFrame:
    row = [(name, "classification", False, None, None, classes)]
    return df.sparkSession.createDataFrame(row, _TARGET_SCHEMA)


def entity_targets_from_profile(profile: DataFrame) -> DataFrame:
    """The status target with its class shares, read from a stored profile alone."""
    total = F.aggregate(F.map_values("category_counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return profile.where(F.col("name") == ENTITY_TARGET).select(
        F.col("name").alias("column"),
        F.lit("classification").alias("task"),
        F.lit(True).alias("is_default"),
        "null_rate",
        "unique_count",
        F.col("categories").alias("classes"),
        F.transform_values("category_counts", lambda _, n: F.round(n / total, 6)).alias("class_balance"),
    )


def targets_from_categories(categories: DataFrame, column: str = ENTITY_TARGET) -> DataFrame:
    """(label, rows, share) of a stored column's classes, one row each, however many there are."""
    own = categories.where(F.col("name") == column).select(F.col("category").alias("label"), "rows")
    total = own.agg(F.sum("rows").alias("n")).select("n").scalar()
    return own.withColumn("share", F.round(F.col("rows") / total, 6))


def problem_type(explicit: str | None, layer: str | None, has_snapshots: bool, has_trajectories: bool) -> str:
    """Named type, else by named layer, else by the layers present; with both, time series."""
    if explicit:
        return explicit
    if layer in ("snapshots", "trajectories"):
        return "time_series" if layer == "snapshots" else "entity_classification"
    if not has_snapshots and has_trajectories:
        return "entity_classification"
    return "time_series"
