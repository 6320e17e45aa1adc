"""Split windows give the rows of plain windows, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.blocks import blocked, ordered_rows
from wayfold.operators.labels import spread
from wayfold.operators.quantile import quantiles
from wayfold.operators.replay import largest
from wayfold.plans.series import series_table
from wayfold.operators.folds import shuffled_folds, temporal_folds, temporal_bounds


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key, and times crowd together at one end."""
    draw = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{draw.randrange(40)}")
        rows.append((key, float(draw.random() ** 4 * 1000) + i * 1e-6, draw.randrange(100) if i % 11 else None))
    return spark.createDataFrame(rows, "k string, t double, v bigint").repartition(6).cache()


def windows(rows):
    w = rows.window
    out = rows.select(
        F.lag("v", 3).over(w).alias("lag3"),
        F.lead("v", 2).over(w).alias("lead2"),
        F.round(F.avg("v").over(w.rowsBetween(-4, 0)), 6).alias("mean5"),
    ).running_sums({"n": F.lit(1), "total": F.col("v")})
    return out.finish().select("k", "t", "v", "lag3", "lead2", "mean5", "n", "total")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("block", [7, 60])
def test_split_equals_plain(skewed, keys, block):
    plain = windows(ordered_rows(skewed, keys, ["t"], 4, 2))
    split = ordered_rows(skewed, keys, ["t"], 4, 2, rows_per_block=block)
    assert split.split
    split = windows(split)
    assert plain.count() == 900
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_short_runs_are_left_whole(skewed):
    """What counts is the longest run, not the size of the table."""
    assert not ordered_rows(skewed, ["k"], ["t"], rows_per_block=400).split
    assert not ordered_rows(skewed, ["k"], ["t"], rows_per_block=7, split=False).split
    assert ordered_rows(skewed, [], ["t"], rows_per_block=400).split


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_without_key_never_meet_in_one_task(spark, tiny):
    """Only the counts per block, never the rows, may be ordered in one task."""
    rows = spark.range(3000).select(
        (F.col("id") * 60).alias("ts"), (F.col("id") % 17).alias("a"), (F.col("id") % 5).alias("avg_wait")
    )
    options = dict(lookback="4m", horizon="1m", lags=("1m",), rolling=("2m",), columns=["a"])
    whole = series_table(rows, **options).rows
    split = series_table(rows, rows_per_block=200, **options).rows
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    assert "SinglePartition" in plan_of(whole)
    lines = plan_of(split).splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) <= 1
    for i in single:
        assert "HashAggregate(keys=[_block" in lines[i + 1]


def test_spread_uses_blocks_of_steps(spark):
    steps = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("eid"),
                                     F.when(F.col("id") < 700, F.col("id")).otherwise(F.lit(0)).alias("step"))
    per = steps.groupBy("eid").agg(F.max("step").alias("last_step"), F.count("*").alias("n"))
    found = spread(steps, per, "n", steps_per_block=50)
    assert found.count() == 1000
    assert found.where("eid = 'hot' and n = 700").count() == 700
    assert found.where("n is null").isEmpty()


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_quantiles_are_exact(spark, limit):
    draw = random.Random(9)
    values = [round(draw.gauss(0, 1), 2) for _ in range(500)] + [0.25] * 250
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ordered = sorted(values)
    asked = [0.0, 0.1, 0.33, 0.5, 0.66, 0.75, 0.999, 1.0]
    expected = [ordered[int(q * (len(ordered) - 1) + 0.5)] for q in asked]
    assert quantiles(df, "x", asked, bracket_limit=limit) == expected
    linear = quantiles(df, "x", [0.333], "linear", bracket_limit=limit)[0]
    spot = 0.333 * (len(ordered) - 1)
    low = ordered[int(spot)]
    assert linear == pytest.approx(low + (ordered[int(spot) + 1] - low) * (spot - int(spot)))


def test_quantile_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        quantiles(spark.createDataFrame([(1.0,)], "x double"), "x", [0.5], "middle")


def test_largest_keeps_exactly_n_among_ties(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("v"))
    kept = largest(df, 73, F.col("v"), F.col("id"), small=0, bracket_limit=2)
    rows = sorted((-r["v"], r["id"]) for r in kept.collect())
    assert rows == sorted((-(i % 4), i) for i in range(200))[:73]
    assert largest(df, 500, F.col("v"), F.col("id"), small=0).count() == 200


def test_folds_share_out_every_row(spark):
    df = spark.range(103).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.col("id").alias("ts"))
    made = shuffled_folds(df, 5, F.col("id"), 7, "label", rows_per_block=4)
    again = shuffled_folds(df, 5, F.col("id"), 7, "label")
    assert made.exceptAll(again).isEmpty()
    per = made.groupBy("label", "fold").count().collect()
    for label in "ab":
        sizes = [r["count"] for r in per if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1

    bounds = temporal_bounds(103, 4)
    assert bounds == [(23, 43), (43, 63), (63, 83), (83, 103)]
    timed = temporal_folds(df, 4, ["ts"], rows_per_block=10).orderBy("ts").collect()
    assert [r["position"] for r in timed] == list(range(103))
    assert [r["fold"] for r in timed] == [-1] * 23 + [i for i in range(4) for _ in range(20)]
    with pytest.raises(ValueError):
        temporal_bounds(3, 5)


@pytest.mark.parametrize("text", [False, True])
def test_one_leading_value_holds_nearly_all_rows(spark, text):
    """Equal times, or equal scores: the next order column splits them, and no block is much larger than asked."""
    ids = F.format_string("x%05d", "id") if text else F.col("id")
    df = spark.range(3000).select(ids.alias("name"), F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(F.lit(777.0)).alias("t")).repartition(5)
    cut = blocked(df, ["t", "name"], 3000, 200)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 600
    rows = ordered_rows(df, [], ["t", "name"], rows_per_block=200, split=True).numbered("n").finish().orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 3001))
    assert [(r["t"], r["name"]) for r in rows] == sorted((r["t"], r["name"]) for r in rows)
