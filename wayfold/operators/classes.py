"""Classes of a column as a table, however many: numbers, counts and weights that are joined back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.names import free_name
from wayfold.model import is_numeric
from wayfold.operators.blocks import ROWS_PER_BLOCK, in_number_order, ordered_rows
from wayfold.session import cut_lineage

# Up to this many classes the table is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_CLASSES = 1_000_000
# A class with at least this share of all rows is hot: there are 1,000 at most, whatever the table holds.
HOT_SHARE = 0.001
# Rows of hot classes, and rows without a class, go to this many places in that shuffle.
SPREAD = 997


def class_table(df: DataFrame, column: str, rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None) -> DataFrame:
    """(class, number, rows) of the non-null values; numbers run from 0 in the order of the values.

    Rows are counted map-side first and the counts written once. Numbering runs over blocks of classes, so only scalars and block
    boundaries come to the driver.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    counts = cut_lineage(counted, "classes")
    number = is_numeric(counts.schema["class"].dataType)
    lead = F.col("class").cast("double") if number else in_number_order(counts, "class")
    placed = ordered_rows(counts.withColumn("lead", lead), [], ["lead", "class"], rows_per_block=rows_per_block, split=split)
    numbered = placed.numbered("position").finish()
    return cut_lineage(numbered.select("class", (F.col("position") - 1).alias("number"), "rows"), "class-numbers")


def with_weights(classes: DataFrame) -> DataFrame:
    """Adds ``weight`` = rows of all / (classes * rows of the class), so that all classes weigh the same."""
    total = classes.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    each = (total["rows"] or 0) / max(total["classes"], 1)
    return classes.withColumn("weight", F.lit(float(each)) / F.col("rows"))


def attach(df: DataFrame, column: str, classes: DataFrame, take: dict[str, str], broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """``df`` with columns of its class: ``take`` names the column of ``classes`` for each new one; null without a class.

    A large table of classes is joined in two steps: hot classes are sent to all tasks, and in the shuffle for the others the rows
    of hot classes are spread by their content, so that no task gets a hot class whole.
    """
    known = classes.agg(F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows")).first()
    key, place = free_name(df, "_class"), free_name(df, "_place")
    slim = classes.select(F.col("class").alias(key), "rows", *[F.col(c).alias(new) for new, c in take.items()])
    ready = df.drop(*take)
    if known["classes"] <= broadcast_classes:
        return ready.join(F.broadcast(slim.drop("rows")), ready[column].eqNullSafe(slim[key]), "left").drop(key)
    hot = slim.where(F.col("rows") >= HOT_SHARE * known["rows"]).drop("rows")
    lead, spread = free_name(df, "_lead"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ready.columns]), F.lit(SPREAD)) + 1
    early = {new: free_name(df, f"_hot_{i}") for i, new in enumerate(take)}
    hot = hot.withColumnsRenamed({key: lead, **early})
    first = ready.join(F.broadcast(hot), ready[column] == hot[lead], "left")
    dealt = first.withColumn(place, F.when(F.col(lead).isNotNull() | F.col(column).isNull(), spread).otherwise(F.lit(0)))
    rest = slim.drop("rows").withColumn(place + "r", F.lit(0).cast("bigint"))
    joined = dealt.join(rest, (dealt[column] == rest[key]) & (dealt[place] == rest[place + "r"]), "left")
    return joined.select(*ready.columns, *[F.coalesce(F.col(early[new]), F.col(new)).alias(new) for new in take])
