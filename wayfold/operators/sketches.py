"""Sketches of a table's columns that are kept beside it and merged with those of other tables.

Distinct values are sketched by 2^12 registers (standard error about 1.6 %). Of numbers, a quantile sketch gives cut points, and the
rows below each cut point are counted exactly; ranks over several tables then read only rows near the wanted one, and counts prove them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.model import is_numeric
from wayfold.operators.profile import as_text
from wayfold.operators.quantile import BRACKET_LIMIT, Bracket, any_of, at_spots, kept_inside, spots_of, values_at_ranks

LG_REGISTERS = 12
KLL_SIZE = 400
CUTS = 64
# Ranks are looked for this far to each side of where the merged sketch puts them, and further if the counts disprove that.
SLACK = 0.02

SKETCHES = (
    "name string, is_numeric boolean, rows bigint, null_count bigint, mean double, m2 double, min double, max double, "
    "distinct binary, quantiles binary, cuts array<double>, under array<bigint>"
)


def column_sketches(df: DataFrame, columns: list[str] | None = None, cuts: int = CUTS) -> DataFrame:
    """One row per column, from one aggregation over the table and one count of rows between cut points.

    ``under`` has the number of rows below each of ``cuts``. Only sketches (some 10 KB a column) come to the driver.
    Nulls are counted apart. Values that are not numbers stand above all others, and no cut point is one.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    wide = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        wide += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.hll_sketch_agg(as_text(df, f.name), F.lit(LG_REGISTERS)).alias(f"distinct{i}")]
        if is_numeric(f.dataType):
            x = c.cast("double")
            wide += [
                F.avg(x).alias(f"mean{i}"), (F.var_pop(x) * F.count(x)).alias(f"m2{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                F.kll_sketch_agg_double(F.when(~F.isnan(x), x), KLL_SIZE).alias(f"quantiles{i}"),
                F.count_if(x.isNotNull() & ~F.isnan(x)).alias(f"numbers{i}"),
            ]
    row = df.agg(*wide).first()
    points = {i: _cut_points(df, row[f"quantiles{i}"], cuts) for i, f in enumerate(fields) if is_numeric(f.dataType) and row[f"numbers{i}"]}
    under = _rows_under(df, {i: (fields[i].name, p) for i, p in points.items() if p})
    out = []
    for i, f in enumerate(fields):
        number = is_numeric(f.dataType)
        stats = [row[f"{s}{i}"] if number else None for s in ("mean", "m2", "min", "max")]
        out.append((
            f.name, number, row["n"], row[f"nulls{i}"], *stats, row[f"distinct{i}"], row[f"quantiles{i}"] if number else None,
            points.get(i, []) if number else None, under.get(i, []) if number else None,
        ))
    return df.sparkSession.createDataFrame(out, SKETCHES)


def _sketched_values(df: DataFrame, sketch: bytearray, shares: list[float]) -> list[float]:
    asked = F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), F.array(*[F.lit(s) for s in shares])).alias("values")
    return df.sparkSession.range(1).select(asked).first()[0]


def _cut_points(df: DataFrame, sketch: bytearray, cuts: int) -> list[float]:
    found = _sketched_values(df, sketch, [i / cuts for i in range(1, cuts)])
    return sorted({x + 0.0 for x in found if math.isfinite(x)})


def _rows_under(df: DataFrame, points: dict[int, tuple[str, list[float]]]) -> dict[int, list[int]]:
    """Rows below each cut point of each column; the binary search runs inside the JVM."""
    if not points:
        return {}
    numbers = df.select(*[F.col(f"`{name}`").cast("double").alias(f"x{i}") for i, (name, _) in points.items()])
    placed = Bucketizer(
        splitsArray=[[-math.inf, *p, math.inf] for _, p in points.values()], inputCols=[f"x{i}" for i in points],
        outputCols=[f"b{i}" for i in points], handleInvalid="keep",
    ).transform(numbers)
    bins = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").cast("int").alias("bin")) for i in points])
    counts = {(r["i"], r["bin"]): r["count"] for r in placed.select(F.inline(bins)).groupBy("i", "bin").count().collect()}
    out = {}
    for i, (_, p) in points.items():
        below, so_far = [], 0
        for b in range(len(p)):
            so_far += counts.get((i, b), 0)
            below.append(so_far)
        out[i] = below
    return out


def joint_profile(sketches: DataFrame, places: int = 6) -> DataFrame:
    """The profile of several tables together, from their sketches alone: everything exact but ``unique_count`` (null counts as one)."""
    present = F.col("rows") - F.col("null_count")
    part = F.struct(present.alias("n"), "mean", "m2")
    merged = sketches.groupBy("name").agg(
        F.bool_and("is_numeric").alias("is_numeric"), F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        (F.sum(F.when(present > 0, F.col("mean") * present)) / F.sum(F.when(present > 0, present))).alias("mean"),
        F.collect_list(F.when(present > 0, part)).alias("parts"),
    )
    n = F.col("rows") - F.col("null_count")
    spread = F.aggregate(
        "parts", F.lit(0.0), lambda total, p: total + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))
    )
    return merged.select(
        "name", "rows", "null_count",
        F.coalesce(F.round(F.try_divide("null_count", "rows"), 6), F.lit(0.0)).alias("null_rate"),
        (F.col("distinct") + F.when(F.col("null_count") > 0, 1).otherwise(0)).alias("unique_count"), "is_numeric",
        F.round("mean", places).alias("mean"), F.round(F.when(F.col("is_numeric") & (n > 1), F.sqrt(spread / (n - 1))), places).alias("std"),
        F.round("min", places).alias("min"), F.round("max", places).alias("max"),
    )


def joint_quantiles(
    parts: list[tuple[DataFrame, DataFrame]], column: str, fractions: list[float], method: str = "nearest", bracket_limit: int = BRACKET_LIMIT,
) -> list[float | None]:
    """Exact quantiles over several (table, sketches) pairs together, as :func:`wayfold.operators.quantile.quantiles` gives over their union.

    The merged sketch brackets a rank. Of each table, rows from the last cut point before the bracket to its end are read (a filter that
    reaches the scan); those before are known by their count.
    """
    kept = [s.where(F.col("name") == column).first() for _, s in parts]
    if any(k is None for k in kept):
        raise ValueError(f"column {column!r} is not sketched in every table")
    n = sum(k["rows"] - k["null_count"] for k in kept)
    if n == 0:
        return [None] * len(fractions)
    # The tables' sketches are unioned as they are stored: one small row each.
    stored = reduce(DataFrame.unionByName, [s.where(F.col("name") == column).select("quantiles") for _, s in parts])
    merged = stored.agg(F.kll_merge_agg_double("quantiles").alias("q"), F.sum(F.kll_sketch_get_n_double("quantiles")).alias("n")).first()
    tables = [(df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x is not null"), k) for (df, _), k in zip(parts, kept, strict=True)]
    spots = spots_of(n, fractions, method)
    ranks = sorted({int(r) for s in spots for r in (math.floor(s), math.ceil(s))})
    found: dict[int, float] = {}
    slack = SLACK if merged["n"] else 1.0
    while len(found) < len(ranks):
        missed = [r for r in ranks if r not in found]
        edges = {r: (r / max(n - 1, 1) - slack, r / max(n - 1, 1) + slack) for r in missed}
        inner = sorted({e for pair in edges.values() for e in pair if 0 < e < 1})
        near = dict(zip(inner, _sketched_values(tables[0][0], merged["q"], inner), strict=True)) if inner else {}
        found |= _at_ranks(tables, {r: (near.get(edges[r][0]), near.get(edges[r][1])) for r in missed}, bracket_limit)
        slack = min(1.0, slack * 4)
    return at_spots(found, spots)


def _at_ranks(tables: list, bounds: dict[int, tuple[float | None, float | None]], bracket_limit: int) -> dict[int, float]:
    """The values at those ranks that lie within their bounds (None: no bound); all ranks share the passes."""
    known, near = dict.fromkeys(bounds, 0), []
    for values, kept in tables:
        read = []
        for r, (low, high) in bounds.items():
            before = [i for i, c in enumerate(kept["cuts"]) if low is not None and c <= low]
            known[r] += kept["under"][before[-1]] if before else 0
            above = F.col("x") >= kept["cuts"][before[-1]] if before else F.lit(True)
            read.append((above if high is None else above & (F.col("x") <= high)).alias(f"r{r}"))
        near.append(values.where(any_of(read)).select("x", *read))
    rows = reduce(DataFrame.unionByName, near)
    below = [F.count_if(F.col(f"r{r}") & (F.col("x") < low)) if low is not None else F.lit(0) for r, (low, _) in bounds.items()]
    seen = rows.agg(*[c.alias(f"b{r}") for r, c in zip(bounds, below)], *[F.count_if(F.col(f"r{r}")).alias(f"r{r}") for r in bounds]).first()
    proven = {
        r: Bracket(low, high, r - known[r] - seen[f"b{r}"], seen[f"r{r}"] - seen[f"b{r}"], open=False)
        for r, (low, high) in bounds.items() if known[r] + seen[f"b{r}"] <= r < known[r] + seen[f"r{r}"]
    }
    if not proven:
        return {}
    inside, n, places = kept_inside(rows.select("x"), proven, bracket_limit)
    found = values_at_ranks(inside, n, sorted(set(places.values())), bracket_limit)
    return {r: found[place] for r, place in places.items()}
