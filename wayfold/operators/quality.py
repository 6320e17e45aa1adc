"""Quality checks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest row count per grade, and the shares above which a finding is an issue.
SIZE_GRADES = ((1000, "excellent"), (200, "good"), (50, "minimal"))
LOWEST_GRADE = "insufficient"
MISSING_SHARE = 0.30
DUPLICATE_SHARE = 0.10


def size_grade(rows: Column) -> Column:
    grade = F.lit(LOWEST_GRADE)
    for least, name in reversed(SIZE_GRADES):
        grade = F.when(rows >= least, F.lit(name)).otherwise(grade)
    return grade


def _quote(name: str) -> Column:
    return F.col(f"`{name}`")


def missing_rates(df: DataFrame) -> DataFrame:
    """(column, missing_rate, issue) for every column, from one aggregation."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_quote(c).isNull()).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.round(F.try_divide(_quote(c), F.col("_n")), 6), F.lit(0.0)).alias("missing_rate"),
        )
        for c in df.columns
    ]
    return wide.select(F.inline(F.array(*rows))).withColumn("issue", F.col("missing_rate") > MISSING_SHARE)


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, constant): at most one distinct non-null value. Smallest equals largest, so nothing is counted."""
    rows = [F.struct(F.lit(c).alias("column"), _constant(c).alias("constant")) for c in df.columns]
    ends = [e for c in df.columns for e in (F.min(_quote(c)).alias(f"{c}|lo"), F.max(_quote(c)).alias(f"{c}|hi"))]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *ends)
    return wide.select(F.inline(F.array(*rows)))


def _constant(name: str) -> Column:
    return (F.col("_n") > 0) & F.col(f"`{name}|lo`").eqNullSafe(F.col(f"`{name}|hi`"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(row_count, duplicate_count, duplicate_rate): copies beyond the first, combined map-side."""
    groups = df.groupBy(*[_quote(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn(
        "duplicate_rate",
        F.coalesce(F.round(F.try_divide(F.col("duplicate_count"), F.col("row_count")), 6), F.lit(0.0)),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Findings as rows (kind, column, value, level, message); level is info, warning or issue."""
    ends = [e for c in df.columns for e in (F.min(_quote(c)).alias(f"{c}|lo"), F.max(_quote(c)).alias(f"{c}|hi"))]
    nulls = [F.count_if(_quote(c).isNull()).alias(f"{c}|nulls") for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *nulls, *ends)
    grade = size_grade(F.col("_n"))
    entries = [
        _finding(
            F.lit("size"), F.lit(None).cast("string"), F.col("_n").cast("double"),
            F.when(grade == LOWEST_GRADE, "issue").otherwise("info"), F.concat(F.lit("data size is "), grade),
        )
    ]
    for c in df.columns:
        rate = F.coalesce(F.round(F.try_divide(F.col(f"`{c}|nulls`"), F.col("_n")), 6), F.lit(0.0))
        entries.append(
            _finding(
                F.lit("missing"), F.lit(c), rate, F.when(rate > MISSING_SHARE, "issue").otherwise("info"),
                F.concat(F.lit(f"column {c} misses "), rate.cast("string")),
            )
        )
        entries.append(
            F.when(
                _constant(c),
                _finding(F.lit("constant"), F.lit(c), F.lit(1.0), F.lit("warning"), F.lit(f"column {c} is constant")),
            )
        )
    copies = duplicate_rows(df).select(
        _finding(
            F.lit("duplicates"), F.lit(None).cast("string"), F.col("duplicate_count").cast("double"),
            F.when(F.col("duplicate_rate") > DUPLICATE_SHARE, "issue").otherwise("info"),
            F.concat(F.col("duplicate_count").cast("string"), F.lit(" duplicate rows")),
        ).alias("f")
    )
    findings = wide.select(F.explode(F.array_compact(F.array(*entries))).alias("f"))
    return findings.unionByName(copies).select("f.*")


def _finding(kind: Column, column: Column, value: Column, level: Column, message: Column) -> Column:
    return F.struct(
        kind.alias("kind"), column.alias("column"), value.alias("value"), level.alias("level"), message.alias("message")
    )
