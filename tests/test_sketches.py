import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.model import Dataset
from wayfold.operators.profile import column_profile
from wayfold.operators.quantile import quantiles
from wayfold.operators.sketches import column_sketches, joint_profile, joint_quantiles
from wayfold.session import cut_lineage
from wayfold.sources.store import DatasetStore

SHARES = [0.0, 0.33, 0.66, 1.0]


def numbers(spark, values):
    return cut_lineage(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1))


def parts_of(spark):
    """Parts of other sizes and ranges: spread, crowded, sorted apart, empty, and only null."""
    rng = random.Random(4)
    return [
        numbers(spark, [rng.gauss(0, 1) for _ in range(4000)]),
        numbers(spark, [float(rng.choice([0, 0, 0, 1])) for _ in range(3000)] + [None] * 50),
        numbers(spark, [float(i) for i in range(500)]),
        numbers(spark, []),
        numbers(spark, [None, None]),
    ]


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_joined_quantiles_are_those_of_the_union(spark, method):
    parts = parts_of(spark)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    want = quantiles(whole, "x", SHARES, method)
    pairs = [(p, column_sketches(p)) for p in parts]
    for limit in (100_000, 50):
        got = joint_quantiles(pairs, "x", SHARES, method, limit)
        assert got == pytest.approx(want)


def test_values_that_are_not_numbers_stand_last(spark):
    a, b = numbers(spark, [1.0, math.nan, math.inf]), numbers(spark, [-math.inf, 2.0, 3.0])
    pairs = [(p, column_sketches(p)) for p in (a, b)]
    got = joint_quantiles(pairs, "x", [0.0, 0.2, 0.4, 0.6, 0.8])
    assert got == [-math.inf, 1.0, 2.0, 3.0, math.inf] and math.isnan(joint_quantiles(pairs, "x", [1.0])[0])


def test_nothing_and_unknown_columns(spark):
    empty = numbers(spark, [])
    pair = (empty, column_sketches(empty))
    assert joint_quantiles([pair, pair], "x", [0.5]) == [None]
    with pytest.raises(ValueError, match="not sketched"):
        joint_quantiles([pair], "y", [0.5])


def test_old_rows_far_from_the_rank_are_not_read(spark, tmp_path):
    """Rows below the cut point are known by their count: they may be gone without changing the answer."""
    old, new = numbers(spark, [float(i) for i in range(10_000)]), numbers(spark, [float(i) + 0.5 for i in range(10_000)])
    kept = [column_sketches(old), column_sketches(new)]
    near = [p.where("x between 4000 and 6000") for p in (old, new)]
    want = quantiles(old.unionByName(new), "x", [0.5])
    assert joint_quantiles(list(zip(near, kept, strict=True)), "x", [0.5]) == want


def test_rows_under_the_cut_points(spark):
    rng = random.Random(5)
    values = [rng.expovariate(1) for _ in range(2000)] + [math.nan, None]
    row = column_sketches(numbers(spark, values)).first()
    real = [v for v in values if v is not None]
    assert row["cuts"] == sorted(set(row["cuts"])) and len(row["cuts"]) > 40
    assert row["under"] == [sum(v < c for v in real) for c in row["cuts"]]
    assert (row["rows"], row["null_count"]) == (2002, 1)


def test_joined_profile_is_that_of_the_union(spark):
    rows = [(i % 7, f"t{i % 900}" if i % 5 else None, float(i * i % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, t string, x double")
    parts = [df.where("a < 3"), df.where("a >= 3"), df.limit(0)]
    sketches = [column_sketches(p) for p in parts]
    got = {r["name"]: r for r in joint_profile(sketches[0].unionByName(sketches[1]).unionByName(sketches[2])).collect()}
    for want in column_profile(df).collect():
        row = got[want["name"]]
        for key in ("null_count", "null_rate", "is_numeric", "min", "max"):
            assert row[key] == want[key]
        for key in ("mean", "std"):
            assert row[key] == pytest.approx(want[key], abs=2e-6)
        assert abs(row["unique_count"] - want["unique_count"]) <= 0.05 * want["unique_count"]
        assert row["rows"] == 3000


def test_stored_sketches_of_two_datasets(spark, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "store"))
    layer = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("double").alias("ts"), (F.col("id") % 50).cast("double").alias("wait"))
    first, second = (store.register(Dataset(snapshots=layer(*r)), sketches=True) for r in ((0, 400), (300, 1000)))
    union = store.read(first, "snapshots").unionByName(store.read(second, "snapshots"))
    assert store.joint_quantiles([first, second], "snapshots", "ts", [0.33, 0.75]) == quantiles(union, "ts", [0.33, 0.75])
    profile = {r["name"]: r for r in store.joint_profile([first, second], "snapshots").collect()}
    assert (profile["ts"]["rows"], profile["ts"]["min"], profile["ts"]["max"]) == (1100, 0.0, 999.0)
    assert abs(profile["ts"]["unique_count"] - 1000) <= 50
    plain = store.register(Dataset(snapshots=layer(0, 10)))
    with pytest.raises(ValueError, match="without sketches"):
        store.sketches(plain, "snapshots")


def test_more_ranks_take_no_more_jobs(spark):
    """All ranks share the passes, with ties, steps and values that are not finite among them."""
    rng = random.Random(11)
    values = [rng.choice([0.0, 1.0, rng.random() * 50, rng.gauss(20, 1)]) for _ in range(4_000)] + [math.inf, -math.inf] * 9
    parts = [numbers(spark, values[::2]), numbers(spark, values[1::2])]
    pairs, ordered, context = [(p, column_sketches(p)) for p in parts], sorted(values), spark.sparkContext
    jobs = []
    for shares in ([0.8], [0.003, 0.2, 0.31, 0.55, 0.6, 0.8, 0.9, 0.999]):
        context.setJobGroup(f"ranks-{len(shares)}", "ranks")
        got = joint_quantiles(pairs, "x", shares, bracket_limit=20)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"ranks-{len(shares)}")))
        assert got == [ordered[math.floor(q * (len(ordered) - 1) + 0.5)] for q in shares]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 2 * jobs[0]
