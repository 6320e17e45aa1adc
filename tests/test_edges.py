"""Values that are not finite, far positions, callers' own helper names, odd steps and the end of a stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators.folds import shuffled_folds
from wayfold.operators.replay import largest
from wayfold.operators.series import LONG_FRAME, rolling_mean, rolling_std, trend, with_running_sums
from wayfold.operators.blocks import ordered_rows
from wayfold.operators.trajectory import advantages
from wayfold.streaming.closing import END, closable, run_to_end
from wayfold.streaming.snapshots import bucketed


def rolled(spark, values, frame, rows_per_block, shift=0):
    rows = spark.createDataFrame([(i + shift, v) for i, v in enumerate(values)], "ts long, x double").repartition(3)
    ready = ordered_rows(rows, [], ["ts"], before=frame, rows_per_block=rows_per_block)
    ready = ready.numbered("_row") if not shift else ready.select(F.col("ts").alias("_row"))
    ready = with_running_sums(ready, {"x": frame})
    w = ready.window
    found = ready.select(rolling_mean("x", w, frame).alias("mean"), rolling_std("x", w, frame).alias("std"), trend("x", w, frame).alias("slope"))
    return [tuple(r) for r in found.finish().orderBy("ts").select("mean", "std", "slope").collect()]


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
@pytest.mark.parametrize("rows_per_block", [60, 10_000])
@pytest.mark.parametrize("frame", [LONG_FRAME - 1, LONG_FRAME])
def test_frames_with_a_value_that_is_not_finite(spark, odd, rows_per_block, frame):
    """Short and long frames, split or whole: not a number just where the frame holds the value, null while it is not full."""
    draw = np.random.default_rng(4)
    values = [float(v) for v in draw.normal(5, 2, 200)]
    values[100], values[20] = odd, None
    for i, (mean, std, slope) in enumerate(rolled(spark, values, frame, rows_per_block)):
        seen = values[max(0, i - frame + 1) : i + 1]
        if len(seen) < frame or None in seen:
            assert mean is None and std is None and slope is None
        elif odd in seen or any(v != v for v in seen):
            assert math.isnan(mean) and math.isnan(std) and math.isnan(slope)
        else:
            wanted = (np.mean(seen), np.std(seen, ddof=1), np.polyfit(range(frame), seen, 1)[0])
            assert (mean, std, slope) == pytest.approx(wanted, rel=1e-9)


def test_slopes_far_down_a_run(spark):
    values = [float(v) for v in np.random.default_rng(5).normal(0, 1, 150)]
    near, far = rolled(spark, values, LONG_FRAME, 10_000), rolled(spark, values, LONG_FRAME, 10_000, shift=10**10)
    for i in range(LONG_FRAME - 1, 150):
        wanted = np.polyfit(range(LONG_FRAME), values[i - LONG_FRAME + 1 : i + 1], 1)[0]
        assert far[i][2] == pytest.approx(near[i][2], rel=1e-12) == pytest.approx(wanted, rel=1e-9)


def test_helper_names_of_the_caller_stay(spark):
    names = ["_key", "_tie", "_block", "_place", "_weight", "_carry", "_rows"]
    rows = spark.range(50).select(F.col("id"), *[F.lit(n).alias(n) for n in names])
    for small in (1, 100):
        best = largest(rows, 7, F.col("id"), F.col("id"), small=small).collect()
        assert {r.id for r in best} == set(range(43, 50)) and all(r[n] == n for r in best for n in names)
    dealt = shuffled_folds(rows, 3, F.col("id"), rows_per_block=10).collect()
    assert len(dealt) == 50 and all(r[n] == n for r in dealt for n in names)
    counts = [sum(r.fold == f for r in dealt) for f in range(3)]
    assert max(counts) - min(counts) <= 1


def recursion(rows, gamma=0.99, lam=0.95):
    out, a, v = {}, 0.0, 0.0
    for i, (step, reward, value, done) in reversed(list(enumerate(rows))):
        on = 0.0 if done else 1.0
        a = reward - value + gamma * on * v + gamma * lam * on * a
        v = value
        out[i] = a
    return [out[i] for i in range(len(rows))]


def test_advantages_of_odd_steps(spark, tiny):
    """Episodes on both sides of a group's width, with negative steps and a row without a step; earlier columns of the same names give way."""
    events = spark.read.parquet(f"{tiny}/events.parquet").where("event_id < 900")
    rows = events.select(
        F.when(F.col("event_id") < 20, "short").otherwise("long").alias("eid"),
        F.when(~F.col("event_id").isin(7, 500), F.col("event_id") - 300).alias("step"),
        (F.col("value") / 100).alias("reward"), (F.col("event_id") % 5 / 10).alias("value"), (F.col("event_id") % 97 == 0).alias("done"),
        F.lit("old").alias("advantage"), F.lit("old").alias("RET"),
    )
    found = advantages(rows)
    assert [c for c in found.columns] == ["eid", "step", "reward", "value", "done", "advantage", "ret"]
    for eid in ("short", "long"):
        own = sorted(found.where(F.col("eid") == eid).collect(), key=lambda r: (r.step is not None, r.step or 0))
        wanted = recursion([(r.step, r.reward, r.value, r.done) for r in own])
        assert [r.advantage for r in own] == pytest.approx(wanted) and [r.ret for r in own] == pytest.approx([w + r.value for w, r in zip(wanted, own)])


def test_the_end_of_a_stream_closes_every_bucket(spark, tmp_path):
    rows = [(i, i % 7, "view", float(i)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 97).cast("timestamp_ntz")
    )
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    folder, out = str(tmp_path / "end"), str(tmp_path / "out")
    found = bucketed(closable(stream, folder), lateness="1 day")
    run_to_end(found, stream.schema, folder, out, str(tmp_path / "state"))
    got, wanted = spark.read.parquet(out), bucketed(events)
    assert got.exceptAll(wanted).isEmpty() and got.count() == wanted.count() == math.ceil(300 * 97 / 3600)
    assert got.where(F.col("ts") >= F.unix_timestamp(F.lit(END))).isEmpty()
