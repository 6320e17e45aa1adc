"""Cross-validation folds as a column, and class weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.hashing import shuffle_key
from wayfold.functions.names import free_name
from wayfold.operators.blocks import ROWS_PER_BLOCK, ordered_rows, positions_by_block
from wayfold.operators.classes import attach, class_table, with_weights


def temporal_bounds(rows: int, folds: int) -> list[tuple[int, int]]:
    """Test range [start, stop) of every fold: equal slabs at the end, trained on everything before."""
    size = rows // (folds + 1)
    if size < 1:
        raise ValueError(f"{rows} rows are too few for {folds} temporal folds")
    first = rows - folds * size
    return [(first + i * size, first + (i + 1) * size) for i in range(folds)]


def temporal_folds(
    df: DataFrame, folds: int, order: list[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Adds ``position`` and ``fold`` (the fold a row is tested in, -1 for rows only trained on).

    Fold i trains on rows with ``position`` below its test start, less a gap if wanted; see :func:`temporal_split`.
    """
    rows = df.count()
    bounds = temporal_bounds(rows, folds)
    ready = ordered_rows(df, [], order, rows_per_block=rows_per_block, rows=rows)
    numbered = ready.numbered("_seen").finish()
    position = (F.col("_seen") - 1).cast("bigint")
    start, size = bounds[0][0], bounds[0][1] - bounds[0][0]
    fold = F.when(position < start, -1).otherwise(F.floor((position - start) / size)).cast("int")
    return numbered.select(*df.columns, position.alias("position"), fold.alias("fold"))


def temporal_split(df: DataFrame, fold: int, bounds: list[tuple[int, int]], gap: int = 0) -> tuple[DataFrame, DataFrame]:
    start, stop = bounds[fold]
    position = F.col("position")
    return df.where(position < start - gap), df.where((position >= start) & (position < stop))


def shuffled_folds(
    df: DataFrame,
    folds: int,
    key: Column,
    seed: int = 42,
    strata: str | None = None,
    group: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    exact: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``fold``: rows in shuffled order dealt out in turn, within each stratum if given.

    ``exact`` folds differ in size by at most one row. Leading hex digits of the
    shuffle key serve as blocks, so even a stratum with most of the rows is numbered in
    many tasks. ``exact=False`` takes the fold from the key alone, with no shuffle at all.
    ``group`` keeps all rows of a group in one fold, chosen from the group's own hash.
    """
    if group is not None:
        return df.withColumn("fold", _hashed_fold(F.col(group), folds, seed))
    if not exact:
        return df.withColumn("fold", _hashed_fold(key, folds, seed))
    rows = df.count() if rows is None else rows
    digits = max(0, math.ceil(math.log(max(rows / rows_per_block, 1), 16)))
    keys = [strata] if strata else []
    own, block, place = (free_name(df, n) for n in ("_key", "_block", "_place"))
    shuffled = df.withColumn(own, shuffle_key(key, seed)).withColumn(block, F.substring(own, 1, digits))
    placed = positions_by_block(shuffled, keys, [F.col(own)], block, place)
    return placed.withColumn("fold", (F.col(place) % folds).cast("int")).drop(own, block, place)


def _hashed_fold(key: Column, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(folds)).cast("int")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class: one entry for each class that a model is to tell apart."""
    return {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def weigh(df: DataFrame, label: str, weights: dict) -> DataFrame:
    """Adds ``weight`` by class; 1 for a class without one. The map has one entry per class, so no join is needed."""
    pairs = [part for c, w in sorted(weights.items()) for part in (F.lit(c), F.lit(float(w)))]
    found = F.create_map(*pairs)[F.col(label)] if pairs else F.lit(None).cast("double")
    return df.withColumn("weight", F.coalesce(found, F.lit(1.0)))


def balanced_class_weights(counts: dict) -> dict:
    """n / (k * n_class) for each class, so that all classes weigh the same."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` by class, from a table of classes that is joined back; 1 for a row without a class."""
    weighed = attach(df, label, with_weights(class_table(df, label)), {"weight": "weight"})
    return weighed.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = negatives / positives for class 1 and 1 for any other."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")).first()
    weight = counts["negatives"] / counts["positives"] if counts["positives"] else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
