"""Metrics, checks, comparisons, rewards and advantages against numbers worked out apart from Spark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.compare import compare_experiments, fold_summary, rank_algorithms, top_importance
from wayfold.operators.gate import Plan, class_findings, gate, warnings
from wayfold.operators.metrics import REGRESSION, auc_binary, auc_one_vs_rest, evaluate, imbalance_report, register_metric, regression_metrics
from wayfold.operators.replay import newest, prioritised_sample, uniform_sample
from wayfold.operators.trajectory import advantages, composite_reward, cost_reward, episode_summary, rewards, sla_reward, throughput_reward, transitions
from wayfold.operators.folds import balanced_weights, positive_weight


def test_regression(spark):
    pairs = [(1.0, 1.1), (2.0, 2.2), (3.0, 2.8), (4.0, 4.1), (5.0, 4.9)]
    found = evaluate(spark.createDataFrame(pairs, "y double, y_pred double"), ["rmse", "mae", "mape", "r2"], "regression")
    assert found["rmse"] == pytest.approx(math.sqrt(0.11 / 5)) and found["mae"] == pytest.approx(0.14)
    assert found["mape"] == pytest.approx((0.1 + 0.1 + 0.2 / 3 + 0.025 + 0.02) / 5) and found["r2"] == pytest.approx(1 - 0.11 / 10)


def test_regression_edges(spark):
    zero = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, y_pred double")
    assert evaluate(zero, ["mape", "r2"], "regression") == {"mape": 0.0, "r2": 0.0}
    same = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "y double, y_pred double")
    assert evaluate(same, ["r2"], "regression") == {"r2": 1.0}
    with pytest.raises(ValueError):
        evaluate(same, ["accuracy"], "regression")


def test_own_metric(spark):
    register_metric("bias", lambda y, p: F.avg(p - y))
    try:
        row = regression_metrics(spark.createDataFrame([(1.0, 3.0)], "y double, y_pred double"), ["bias"]).first()
        assert row["bias"] == 2.0
        with pytest.raises(ValueError):
            register_metric("bias", lambda y, p: F.avg(y))
    finally:
        del REGRESSION["bias"]


def test_classification(spark):
    y, p, s = [0, 1, 1, 0, 1, 0, 1, 1], [0, 1, 1, 0, 1, 1, 1, 0], [0.1, 0.8, 0.7, 0.2, 0.9, 0.6, 0.85, 0.4]
    df = spark.createDataFrame([(a, b, [1 - c, c]) for a, b, c in zip(y, p, s)], "y int, y_pred int, proba array<double>")
    found = evaluate(df, ["accuracy", "precision", "recall", "f1_weighted", "f1_macro", "auc_roc"], "classification", 2, "proba")
    assert found["accuracy"] == 0.75 and found["recall"] == pytest.approx(0.75)
    assert found["precision"] == pytest.approx((3 * 2 / 3 + 5 * 0.8) / 8)
    assert found["f1_macro"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert found["auc_roc"] == pytest.approx(14 / 15)
    assert evaluate(df, ["auc_roc"], "classification")["auc_roc"] == 0.0


def brute_area(hits):
    good = [s for h, s in hits if h]
    bad = [s for h, s in hits if not h]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("block", [9, 1000])
def test_area_equals_counting_pairs(spark, block):
    draw = random.Random(3)
    rows = [(draw.randrange(3), [round(draw.random(), 1) for _ in range(3)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, proba array<double>")
    one = auc_binary(df, F.col("y") == 2, F.col("proba")[2], rows_per_block=block).first()[0]
    assert one == pytest.approx(brute_area([(y == 2, p[2]) for y, p in rows]))
    every = auc_one_vs_rest(df, "y", "proba", 3, rows_per_block=block).first()[0]
    expected = sum(brute_area([(y == c, p[c]) for y, p in rows]) * sum(y == c for y, _ in rows) for c in range(3)) / 150
    assert every == pytest.approx(expected)


def test_undefined_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert auc_binary(df, F.col("y") == 1, F.col("s")).first()[0] is None
    assert auc_binary(df, F.col("y") == 1, F.col("s"), True).first()[0] == 0.0


def codes(df):
    return sorted(r["code"] for r in df.collect())


def test_gate(spark):
    good = spark.range(100).select((F.col("id") * 300).alias("ts"), F.col("id").cast("double").alias("avg_wait"))
    fine = Plan("avg_wait", lookback="1h", horizon="5m", lags=("30m",))
    assert codes(gate(good, fine)) == []
    assert codes(gate(good.limit(10), fine)) == ["V-02", "VT-02"]
    assert codes(gate(good.limit(40), fine)) == ["V-02", "VT-03"]
    assert codes(gate(good.drop("ts"), fine)) == ["VT-01"]
    assert codes(gate(good.withColumn("avg_wait", F.when(F.col("ts") > 4000, F.col("avg_wait"))), fine)) == ["V-11"]
    dated = good.withColumn("ts", F.timestamp_seconds("ts"))
    assert codes(gate(dated, fine)) == []
    bad = Plan("nothing", features=("nothing",), seed=-1, algorithms=("magic",), folds=1, metrics=("luck",), lags=("9h",), lookback="1h", horizon="5m", strategy="stratified")
    assert codes(gate(good, bad)) == ["V-03", "V-04", "V-05", "V-07", "V-08", "V-09", "V-10", "VT-05", "VT-06"]
    assert warnings(Plan("total_processed"))[0][0] == "W-01" and warnings(fine) == []


def test_class_checks(spark):
    entities = spark.range(200).select(F.col("id").cast("string").alias("eid"), F.when(F.col("id") < 5, "rare").otherwise("usual").alias("status"))
    plan = Plan("status", "entity_classification", point="entry_only")
    found = gate(entities, plan).collect()
    assert [r["code"] for r in found] == ["VE-02"] and "rare" in found[0]["message"]
    assert codes(gate(entities, Plan("delay_severity", "entity_classification"))) == []
    numbers = entities.select(F.monotonically_increasing_id().alias("n"))
    assert codes(class_findings(numbers, "n")) == ["VE-01"] + ["VE-02"] * 200 + ["VE-03"]


def test_ranking(spark):
    rows = [("a", 0, "rmse", 1.0), ("a", 1, "rmse", 3.0), ("b", 0, "rmse", 1.5), ("b", 1, "rmse", 1.5), ("c", 0, "rmse", None)]
    summary = fold_summary(spark.createDataFrame(rows, "algorithm string, fold int, metric string, value double"))
    assert [r["algorithm"] for r in rank_algorithms(summary, "rmse").orderBy("rank").collect()] == ["b", "a", "c"]
    assert summary.where("algorithm = 'a'").first()["std"] == 1.0


def test_comparison(spark):
    rows = [("x", "one", "completed", {"f1": 0.5, "rmse": 2.0}), ("y", "two", "completed", {"f1": 0.7}), ("z", "three", "failed", {"f1": 0.9})]
    df = spark.createDataFrame(rows, "experiment_id string, name string, status string, metrics map<string,double>")
    assert [r["experiment_id"] for r in compare_experiments(df).orderBy("rank").collect()] == ["y", "x"]
    by_error = compare_experiments(df, ["f1", "rmse"], "rmse").orderBy("rank").collect()
    assert [(r["experiment_id"], r["rmse"]) for r in by_error] == [("x", 2.0), ("y", None)]
    many = spark.range(60).select(
        F.format_string("e%02d", "id").alias("experiment_id"), F.lit("n").alias("name"), F.lit("completed").alias("status"),
        F.create_map(F.lit("f1"), F.floor(F.col("id") / 3) / 10).alias("metrics"))
    split = compare_experiments(many, rows_per_block=7).orderBy("rank").collect()
    expected = sorted(range(60), key=lambda i: (-(i // 3), i))
    assert [r["experiment_id"] for r in split] == [f"e{i:02d}" for i in expected] and split[-1]["rank"] == 60
    with pytest.raises(ValueError):
        compare_experiments(df, rank_by="luck")
    with pytest.raises(ValueError):
        compare_experiments(df.where("status = 'failed'"))


def test_importance_and_balance(spark):
    top = top_importance(spark.createDataFrame([("a", -3.0), ("b", 1.0), ("c", 0.0)], "feature string, raw double"), 2).collect()
    assert [(r["feature"], r["importance"], r["rank"]) for r in top] == [("a", 0.75, 1), ("b", 0.25, 2)]
    df = spark.createDataFrame([("x", 0)] * 3 + [("y", 0)] + [("x", 1)], "label string, fold int")
    found = {r["fold"]: r for r in imbalance_report(df, "label", "fold").collect()}
    assert found[0]["imbalance_ratio"] == 3.0 and found[0]["minority_share"] == 0.25 and found[1]["single_class"]


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {(r["label"], r["weight"]) for r in balanced_weights(df, "label").collect()} == {(0, 8 / 12), (1, 2.0)}
    assert {(r["label"], r["weight"]) for r in positive_weight(df, "label").collect()} == {(0, 1.0), (1, 3.0)}
    many = balanced_weights(spark.range(30).toDF("label"), "label")
    assert {r["weight"] for r in many.collect()} == {1.0}


STATE = "eid string, step int, completed_count int, sla_breaches int, total_cost double, done boolean"


def test_rewards(spark):
    df = spark.createDataFrame([
        ("a", 0, 5, 0, 100.0, False), ("a", 1, 7, 0, 120.0, False),
        ("b", 0, None, None, None, False), ("b", 1, 1, 1, 50.0, False),
        ("c", 0, 0, 0, 0.0, False), ("c", 1, 1, 0, 0.0, True)], STATE)
    rules = {
        "half_cost": composite_reward([(throughput_reward(), 1.0), (cost_reward(), 0.5)]),
        "all": composite_reward([(throughput_reward(), 1.0), (sla_reward(), 1.0), (cost_reward(), 0.1)]),
        "sla": sla_reward(), "none": composite_reward([]),
    }
    found = {(r["eid"], r["step"]): r for r in rewards(df, rules).collect()}
    assert found["a", 1]["half_cost"] == -8.0
    assert found["b", 1]["all"] == -14.0
    assert found["c", 1]["sla"] == 1.0 and found["c", 0]["sla"] == 0.0 and found["c", 1]["none"] == 0.0


def test_transitions_stop_at_the_cap(spark):
    df = spark.createDataFrame([("a", i, float(i), i == 3) for i in range(4)], "eid string, step int, s double, done boolean")
    made = transitions(df, F.col("s"), F.lit(0), F.col("s")).orderBy("step").collect()
    assert [(r["state"], r["next_state"], r["done"]) for r in made] == [(0.0, 1.0, False), (1.0, 2.0, False), (2.0, 3.0, True)]
    capped = transitions(df, F.col("s"), F.lit(0), F.col("s"), max_steps=2).orderBy("step").collect()
    assert [r["done"] for r in capped] == [False, True]


def test_advantages_of_three_steps(spark):
    df = spark.createDataFrame([("e", i, 1.0, 0.0, i == 2) for i in range(3)], "eid string, step int, reward double, value double, done boolean")
    found = advantages(df, gamma=1.0, lam=1.0).orderBy("step").collect()
    assert [r["advantage"] for r in found] == [3.0, 2.0, 1.0] and [r["ret"] for r in found] == [3.0, 2.0, 1.0]


@pytest.mark.parametrize("fan_in", [3, 256])
def test_advantages_in_rounds(spark, fan_in):
    draw = random.Random(1)
    expected, rows = {}, []
    for name, n in (("long", 400), ("short", 3), ("one", 1)):
        run = [(draw.random(), draw.random(), draw.random() < 0.05) for _ in range(n)]
        carry, ahead = 0.0, 0.4
        for t in reversed(range(n)):
            reward, value, done = run[t]
            go = 0.0 if done else 1.0
            carry = reward + 0.9 * ahead * go - value + 0.9 * 0.8 * go * carry
            expected[name, t], ahead = carry, value
        rows += [(name, t, *run[t]) for t in range(n)]
    df = spark.createDataFrame(rows, "eid string, step int, reward double, value double, done boolean").repartition(5)
    found = advantages(df, 0.9, 0.8, 0.4, fan_in=fan_in).collect()
    assert len(found) == 404
    for r in found:
        assert r["advantage"] == pytest.approx(expected[r["eid"], r["step"]])


def test_episodes_and_buffers(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", -2.0)], "eid string, reward double")
    row = episode_summary(df).first()
    assert (row["mean_reward"], row["std_reward"], row["success_rate"], row["mean_length"]) == (1.0, 3.0, 0.5, 1.5)
    seq = spark.range(100).toDF("id")
    assert sorted(r["id"] for r in newest(seq, 3, "id").collect()) == [97, 98, 99]
    first, second = (uniform_sample(seq, 20, F.col("id"), s) for s in (1, 2))
    assert first.count() == 20 and first.exceptAll(uniform_sample(seq, 20, F.col("id"), 1)).isEmpty()
    assert not first.exceptAll(second).isEmpty()
    assert uniform_sample(seq, 500, F.col("id"), 1).count() == 100


def test_high_priority_wins(spark):
    pair = spark.createDataFrame([(0, 0.01), (1, 100.0)], "id int, p double").cache()
    wins = sum(prioritised_sample(pair, 1, F.col("p"), F.col("id"), seed, 1.0).first()["id"] for seed in range(15))
    assert wins == 15


def test_all_steps_sees_every_event(spark, tiny):
    from wayfold.catalog.trajectories import all_steps

    events = spark.read.parquet(f"{tiny}/events.parquet")
    rows = all_steps(spark, tiny).collect()
    assert len(rows) == events.count() > 900
    assert sum(r.step is None for r in rows) == len({r.eid for r in rows}) > 2
    assert sum(r.step is not None and r.step < 0 for r in rows) > len(rows) / 3
