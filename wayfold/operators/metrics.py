"""Evaluation measures as aggregations over a predictions table.

A predictions table has ``y`` and ``y_pred``; ranking measures also take a score per
class. Regression measures share one aggregation. Classification measures share one
confusion count, after which only (classes x classes) rows are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.blocks import ROWS_PER_BLOCK, ordered_rows

LOWER_IS_BETTER = ("rmse", "mae", "mape")


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute relative error over rows with a nonzero truth; 0 without any."""
    return F.coalesce(F.avg(F.when(y != 0, F.abs((y - p) / y))), F.lit(0.0))


def r2(y: Column, p: Column) -> Column:
    left = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    return F.when(spread > 0, 1 - left / spread).otherwise(F.when(left == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


REGRESSION: dict[str, Callable[[Column, Column], Column]] = {"rmse": rmse, "mae": mae, "mape": mape, "r2": r2}
CLASSIFICATION = ("f1_weighted", "f1_macro", "precision", "recall", "accuracy")
RANKING = ("auc_roc",)


def register_metric(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Add a regression measure built from truth and prediction."""
    if name in REGRESSION or name in CLASSIFICATION or name in RANKING:
        raise ValueError(f"metric {name!r} exists already")
    REGRESSION[name] = build


def regression_metrics(predictions: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """The named measures in one row (per group of ``by``)."""
    unknown = [n for n in names if n not in REGRESSION]
    if unknown:
        raise ValueError(f"unknown regression metrics: {unknown}")
    y, p = F.col("y").cast("double"), F.col("y_pred").cast("double")
    return predictions.groupBy(*(by or [])).agg(*[REGRESSION[n](y, p).alias(n) for n in names])


def confusion_counts(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(y, y_pred, rows)."""
    return predictions.groupBy(*(by or []), "y", "y_pred").agg(F.count(F.lit(1)).alias("rows"))


def confusion_matrix(predictions: DataFrame, classes: list) -> DataFrame:
    """One row per true class and one column per predicted class, in the order of ``classes``."""
    cells = [F.coalesce(F.sum(F.when(F.col("y_pred") == c, F.col("rows"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    return confusion_counts(predictions).groupBy(F.col("y").alias("actual")).agg(*cells).orderBy("actual")


def class_scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 per class over all classes seen as truth or prediction; 0 where undefined."""
    keys = by or []
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("y_pred"), F.col("rows")).otherwise(0).alias("hits")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    totals = (
        confusion_counts(predictions, keys)
        .select(*keys, F.inline(sides))
        .groupBy(*keys, "class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    both = F.col("predicted") + F.col("support")
    return totals.select(
        "*", precision.alias("precision"), recall.alias("recall"),
        F.when(both > 0, 2 * F.col("hits") / both).otherwise(F.lit(0.0)).alias("f1"),
    )


def classification_metrics(predictions: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """The named measures in one row (per group of ``by``)."""
    def weighted(column: str) -> Column:
        return F.sum(F.col(column) * F.col("support")) / F.sum("support")

    built = {
        "f1_weighted": weighted("f1"),
        "f1_macro": F.avg("f1"),
        "precision": weighted("precision"),
        "recall": weighted("recall"),
        "accuracy": F.sum("hits") / F.sum("support"),
    }
    unknown = [n for n in names if n not in built]
    if unknown:
        raise ValueError(f"unknown classification metrics: {unknown}")
    return class_scores(predictions, by).groupBy(*(by or [])).agg(*[built[n].alias(n) for n in names])


def auc_binary(
    scored: DataFrame, positive: Column, score: Column, zero_if_undefined: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None,
) -> DataFrame:
    """Exact area under the ROC curve; null (or 0) when a class is missing.

    Rows collapse to one per distinct score before anything is ordered, and the
    running count of negatives runs over blocks of scores, never in one task.
    """
    points = scored.select(F.lit(0).alias("class"), positive.cast("int").alias("hit"), score.cast("double").alias("score"))
    areas = _areas(points, rows_per_block, split)
    return areas.agg(_area(zero_if_undefined).alias("auc_roc"))


def auc_one_vs_rest(
    scored: DataFrame, y: str, probabilities: str, classes: int, zero_if_undefined: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None,
) -> DataFrame:
    """Support-weighted mean of one-versus-rest areas; ``y`` is a class number, ``probabilities`` an array."""
    per_class = F.array(
        *[
            F.struct(F.lit(c).alias("class"), (F.col(y) == c).cast("int").alias("hit"),
                     F.coalesce(F.get(probabilities, c).cast("double"), F.lit(0.0)).alias("score"))
            for c in range(classes)
        ]
    )
    areas = _areas(scored.select(F.inline(per_class)), rows_per_block, split)
    per = areas.groupBy("class").agg(_area(False).alias("area"), F.sum("hits").alias("support"))
    # One class without positives or without negatives leaves the mean undefined.
    mean = F.when(F.count("area") == classes, F.sum(F.col("area") * F.col("support")) / F.sum("support"))
    return per.agg((F.coalesce(mean, F.lit(0.0)) if zero_if_undefined else mean).alias("auc_roc"))


def _areas(points: DataFrame, rows_per_block: int, split: bool | None) -> DataFrame:
    by_score = points.groupBy("class", "score").agg(
        F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses")
    )
    # The number of distinct scores is not known ahead; the row count bounds it.
    rows = ordered_rows(by_score, ["class"], ["score"], 0, 0, rows_per_block, points.count(), split)
    running = rows.running_sums({"upto": F.col("misses")}).finish()
    return running.select(
        "class", "hits", "misses",
        (F.col("hits") * (F.col("upto") - F.col("misses") + F.col("misses") / F.lit(2.0))).alias("wins"),
    )


def _area(zero_if_undefined: bool) -> Column:
    pairs = F.sum("hits").cast("double") * F.sum("misses").cast("double")
    area = F.when(pairs > 0, F.sum("wins") / pairs)
    return F.coalesce(area, F.lit(0.0)) if zero_if_undefined else area


def evaluate(
    predictions: DataFrame,
    names: list[str],
    task: str,
    classes: int = 0,
    probabilities: str | None = None,
    zero_if_undefined: bool = True,
) -> dict[str, float | None]:
    """A named set of measures as a dictionary; unknown names are an error."""
    known = [*REGRESSION] if task == "regression" else [*CLASSIFICATION, *RANKING]
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown metrics for {task}: {unknown}")
    if task == "regression":
        row = regression_metrics(predictions, names).first()
        return {n: row[n] for n in names}
    found: dict[str, float | None] = {}
    counted = [n for n in names if n in CLASSIFICATION]
    if counted:
        row = classification_metrics(predictions, counted).first()
        found |= {n: row[n] for n in counted}
    if "auc_roc" in names:
        if probabilities is None or classes < 2:
            found["auc_roc"] = 0.0 if zero_if_undefined else None
        elif classes == 2:
            positive, score = F.col("y") == 1, F.coalesce(F.get(probabilities, 1), F.lit(0.0))
            found["auc_roc"] = auc_binary(predictions, positive, score, zero_if_undefined).first()[0]
        else:
            found["auc_roc"] = auc_one_vs_rest(predictions, "y", probabilities, classes, zero_if_undefined).first()[0]
    return {n: found[n] for n in names}


def prediction_sample(predictions: DataFrame, keys: list[str], size: int = 100, probabilities: str | None = None) -> DataFrame:
    """The first ``size`` rows by key, probabilities rounded to 4 places."""
    columns = [*keys, "y", "y_pred"]
    rounded = [F.transform(probabilities, lambda v: F.round(v, 4)).alias("probabilities")] if probabilities else []
    sample = predictions.select(*columns, *rounded)
    return (sample.orderBy(*keys) if keys else sample).limit(size)


def imbalance_report(df: DataFrame, label: str, fold: str | None = None) -> DataFrame:
    """Classes, smallest class share and largest-to-smallest ratio (per fold); a single class is flagged."""
    keys = [fold] if fold else []
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("rows").alias("rows"),
        (F.min("rows") / F.sum("rows")).alias("minority_share"),
        (F.max("rows") / F.min("rows")).alias("imbalance_ratio"),
        (F.count(F.lit(1)) == 1).alias("single_class"),
    )
