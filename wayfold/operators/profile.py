"""Column profile of a table in one pass over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.model import is_numeric, is_text, text_columns

# Up to this many distinct values, a text column's categories are also listed in its profile row.
LISTED_CATEGORIES = 1000


def column_profile(df: DataFrame, exact: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row per column: type, nulls, distinct values (null counts as one), moments and range of numbers.

    One aggregation covers every column, and one grouped count all exact distinct counts.
    ``exact=False`` takes those from a sketch in the first pass, which shuffles no values at all.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        c = F.col(f"`{f.name}`")
        aggregates.append(F.count_if(c.isNull()).alias(f"{f.name}|nulls"))
        if not exact:
            aggregates.append(F.approx_count_distinct(c).alias(f"{f.name}|distinct"))
        if is_numeric(f.dataType):
            for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                aggregates.append(fn(c.cast("double")).alias(f"{f.name}|{stat}"))
    wide = df.agg(*aggregates)

    def stat(f, name):
        if not is_numeric(f.dataType):
            return F.lit(None).cast("double")
        return F.round(F.col(f"`{f.name}|{name}`"), 6)

    rows = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"`{f.name}|nulls`").alias("null_count"),
            F.coalesce(F.round(F.try_divide(F.col(f"`{f.name}|nulls`"), F.col("_n")), 6), F.lit(0.0)).alias("null_rate"),
            (F.lit(None).cast("bigint") if exact else F.col(f"`{f.name}|distinct`")).alias("_distinct"),
            F.lit(is_numeric(f.dataType)).alias("is_numeric"),
            F.lit(is_text(f.dataType)).alias("is_categorical"),
            stat(f, "mean").alias("mean"),
            stat(f, "std").alias("std"),
            stat(f, "min").alias("min"),
            stat(f, "max").alias("max"),
        )
        for f in fields
    ]
    measured = wide.select(F.inline(F.array(*rows)))
    if exact:
        measured = measured.drop("_distinct").join(distinct_counts(df, [f.name for f in fields]), "name", "left")
    unique = F.coalesce("_distinct", F.lit(0)) + F.when(F.col("null_count") > 0, 1).otherwise(0)
    return measured.select(
        "name", "dtype", "null_count", "null_rate", unique.alias("unique_count"), "is_numeric", "is_categorical",
        "mean", "std", "min", "max",
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, _distinct) of non-null values: (column, value) pairs are combined map-side, then counted per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), as_text(df, c).alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    return values.groupBy("name").agg(F.count(F.lit(1)).alias("_distinct"))


def as_text(df: DataFrame, name: str) -> Column:
    """Equal values, and only those, get equal texts."""
    c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return F.hex(c) if isinstance(dtype, T.BinaryType) else c.cast("string")


def category_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(name, category, rows) for the non-null values of text columns, whole and in one shuffle."""
    names = columns or text_columns(df)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("category")) for n in names])
    return (
        df.select(F.inline(pairs))
        .where(F.col("category").isNotNull())
        .groupBy("name", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def full_profile(df: DataFrame, exact: bool = True, listed: int = LISTED_CATEGORIES) -> DataFrame:
    """The column profile with ``categories`` and ``category_counts`` of text columns.

    A column with more than ``listed`` categories has null there; its counts are all in :func:`category_counts`.
    """
    measured = column_profile(df, exact)
    # One row per column comes back, so the pass over the table is made once.
    rows = measured.collect()
    profile = df.sparkSession.createDataFrame(rows, measured.schema)
    few = [r["name"] for r in rows if r["is_categorical"] and r["unique_count"] <= listed]
    if not few:
        empty = F.lit(None)
        return profile.select("*", empty.cast("array<string>").alias("categories"),
                              empty.cast("map<string,bigint>").alias("category_counts"))
    gathered = (
        category_counts(df, few)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("category", "rows"))).alias("entries"))
        .select(
            "name",
            F.col("entries.category").alias("categories"),
            F.map_from_entries("entries").alias("category_counts"),
        )
    )
    return profile.join(gathered, "name", "left")
