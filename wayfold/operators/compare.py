"""Rankings of algorithms and experiments from score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.blocks import ROWS_PER_BLOCK, ordered_rows
from wayfold.operators.metrics import LOWER_IS_BETTER


def better_first(metric: str, value: Column) -> Column:
    """Sort order that puts the better value first and a missing one last."""
    return value.asc_nulls_last() if metric in LOWER_IS_BETTER else value.desc_nulls_last()


def fold_summary(scores: DataFrame) -> DataFrame:
    """(algorithm, metric, mean, std) over folds, with the population deviation."""
    return scores.groupBy("algorithm", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds")
    )


def rank_algorithms(summary: DataFrame, metric: str) -> DataFrame:
    """Rank 1 is the best mean of ``metric``; the table has one row per algorithm and metric."""
    chosen = summary.where(F.col("metric") == metric)
    order = Window.partitionBy("metric").orderBy(better_first(metric, F.col("mean")), "algorithm")
    return chosen.select("algorithm", "metric", "mean", "std", F.row_number().over(order).alias("rank"))


def common_metrics(experiments: DataFrame) -> DataFrame:
    """(metric) present in every completed experiment that has metrics at all."""
    done = experiments.where((F.col("status") == "completed") & (F.size("metrics") > 0))
    total = done.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return (
        done.select(F.explode(F.map_keys("metrics")).alias("metric"))
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == total)
        .select("metric")
    )


def compare_experiments(
    experiments: DataFrame, metrics: list[str] | None = None, rank_by: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Completed experiments with the shared metrics side by side, ranked by one of them."""
    names = metrics or sorted(r["metric"] for r in common_metrics(experiments).collect())
    if not names:
        raise ValueError("the completed experiments share no metric")
    chosen = rank_by or names[0]
    done = experiments.where(F.col("status") == "completed")
    if done.where(F.map_contains_key("metrics", F.lit(chosen))).isEmpty():
        raise ValueError(f"no completed experiment has the metric {chosen!r}")
    wide = done.select(
        "experiment_id", "name",
        *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names],
        F.try_element_at("metrics", F.lit(chosen)).alias("_ranked"),
    )
    sign = 1.0 if chosen in LOWER_IS_BETTER else -1.0
    placed = wide.withColumn("_place", F.coalesce(F.col("_ranked") * sign, F.lit(float("inf"))))
    rows = ordered_rows(placed, [], ["_place", "experiment_id"], rows_per_block=rows_per_block)
    return rows.numbered("rank").finish().drop("_ranked", "_place")


def top_importance(importance: DataFrame, k: int = 20) -> DataFrame:
    """Absolute importances scaled to sum to 1, largest first, ranked, the first ``k``; one row per feature."""
    total = importance.agg(F.sum(F.abs("raw")).alias("t")).select("t").scalar()
    scaled = importance.select("feature", F.coalesce(F.try_divide(F.abs("raw"), total), F.lit(0.0)).alias("importance"))
    # Only the first k rows are left when they are numbered.
    first = scaled.orderBy(F.desc("importance"), "feature").limit(k)
    order = Window.orderBy(F.desc("importance"), "feature")
    return first.withColumn("rank", F.row_number().over(order)).orderBy("rank")
