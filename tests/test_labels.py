"""Derived labels and observation points on frames small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions.encode import encoding_of
from wayfold.operators.labels import delay_severity, derive, limit_column, sla_breach, wait_ratio_class
from wayfold.operators.observation import observe
from wayfold.operators.selection import entity_features
from wayfold.plans.entity import entity_table

SCHEMA = "eid string, step int, done boolean, total_time double, s_cum_wait double, s_cum_processing double"


@pytest.fixture(scope="module")
def journeys(spark):
    """20 entities of 4 steps; entity i takes 100 + 50 i in all and waits a growing share of it."""
    rows = []
    for i in range(20):
        total = 100.0 + 50 * i
        share = 0.1 + 0.7 * i / 19
        for step in range(4):
            part = total * (step + 1) / 4
            rows.append((f"e{i:02d}", step, step == 3, total if step == 3 else None, share * part, (1 - share) * part))
    return spark.createDataFrame(rows, SCHEMA)


def per_entity(df, label):
    found = df.groupBy("eid").agg(F.collect_set(label).alias("l")).collect()
    assert all(len(r["l"]) == 1 for r in found), "one label per entity"
    return {r["eid"]: r["l"][0] for r in found}


def test_limit_from_column_is_strict(journeys):
    labels = per_entity(sla_breach(journeys.withColumn("sla_order_completion_limit", F.lit(600.0))), "sla_breach")
    assert {e for e, l in labels.items() if l == "breach"} == {f"e{i:02d}" for i in range(11, 20)}


def test_fixed_threshold_beats_column(journeys):
    df = journeys.withColumn("sla_order_completion_limit", F.lit(1.0))
    labels = per_entity(sla_breach(df, threshold=900.0), "sla_breach")
    assert sorted(e for e, l in labels.items() if l == "breach") == ["e17", "e18", "e19"]


def test_fallback_is_the_nearest_rank_quantile(journeys):
    labels = per_entity(derive(journeys, "sla_breach"), "sla_breach")
    assert sum(l == "breach" for l in labels.values()) == 5  # rank round(0.75 * 19) = 14 stays within


def test_delay_classes_are_balanced(journeys):
    labels = per_entity(delay_severity(journeys), "delay_severity")
    counts = [sum(l == n for l in labels.values()) for n in ("on_time", "minor_delay", "major_delay")]
    assert counts == [7, 7, 6]
    assert labels["e00"] == "on_time" and labels["e19"] == "major_delay"


def test_four_named_classes(journeys):
    made = delay_severity(journeys, (0.25, 0.5, 0.75), ("a", "b", "c", "d"))
    assert set(per_entity(made, "delay_severity").values()) == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        delay_severity(journeys, (0.5,), ("one",))


def test_fixed_cuts(spark):
    rows = [(n, 0, True, 100.0, w, p) for n, w, p in (("low", 10.0, 90.0), ("edge", 30.0, 70.0), ("mid", 50.0, 50.0), ("high", 80.0, 20.0), ("still", 0.0, 0.0))]
    found = per_entity(wait_ratio_class(spark.createDataFrame(rows, SCHEMA)), "wait_ratio_class")
    assert found == {"low": "efficient", "edge": "efficient", "mid": "moderate", "high": "congested", "still": "efficient"}


def test_missing_values_keep_the_order_of_the_rules(spark):
    rows = [("no_total", 0, True, None, 5.0, 5.0), ("no_wait", 0, True, 10.0, None, 5.0), ("open", 0, False, None, 1.0, 1.0), ("x", 0, True, 10.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    delay = per_entity(delay_severity(df), "delay_severity")
    assert delay["no_total"] == "on_time" and delay["no_wait"] == "major_delay" and delay["open"] == "unknown"
    assert per_entity(wait_ratio_class(df), "wait_ratio_class")["no_wait"] == "efficient"
    assert per_entity(sla_breach(df, threshold=5.0), "sla_breach") == {"no_total": "no_breach", "no_wait": "breach", "open": "unknown", "x": "breach"}


def test_nobody_completed(journeys):
    df = journeys.withColumn("done", F.lit(False))
    for target in ("sla_breach", "delay_severity", "wait_ratio_class"):
        assert set(per_entity(derive(df, target), target).values()) == {"unknown"}


def test_errors(journeys):
    with pytest.raises(ValueError):
        derive(journeys, "mood")
    with pytest.raises(ValueError):
        derive(journeys.drop("eid"), "sla_breach")
    assert limit_column(["a", "sla_z", "sla_b"]) == "sla_b"
    assert limit_column(["sla_a", "sla_resolution_limit"]) == "sla_resolution_limit"
    assert limit_column(["x"]) is None


def test_observation_points(spark):
    rows = [("a", s) for s in range(6)] + [("b", 0), ("c", 0), ("c", 1), ("d", 0), ("d", 3)]
    df = spark.createDataFrame(rows, "eid string, step int")
    assert {tuple(r) for r in observe(df, "entry_only").collect()} == {(e, 0) for e in "abcd"}
    assert {tuple(r) for r in observe(df, "midpoint").collect()} == {("a", 3), ("b", 0), ("c", 1)}
    assert {tuple(r) for r in observe(df, "midpoint", tie="half_even").collect()} == {("a", 2), ("b", 0), ("c", 0)}
    assert {tuple(r) for r in observe(df, "midpoint", nearest=True).collect()} == {("a", 3), ("b", 0), ("c", 1), ("d", 3)}
    with pytest.raises(ValueError):
        observe(df, "sometimes")


def test_outcome_columns_never_become_features(journeys):
    df = journeys.withColumn("sla_x", F.lit(1)).withColumn("s_attr_age", F.lit(3)).withColumn("s_attr_name", F.lit("n"))
    assert entity_features(df, "delay_severity") == ["s_cum_wait", "s_cum_processing", "s_attr_age"]
    with pytest.raises(ValueError):
        entity_features(df, "delay_severity", columns=["s_cum_wait", "total_time"])


def test_entity_table(journeys):
    df = journeys.withColumn("s_elapsed", F.when(F.col("step") > 0, F.col("step") * 10.0))
    made = entity_table(df, "wait_ratio_class", "entry_only")
    assert made.encoding.names == ["congested", "efficient", "moderate"]
    assert made.features == ("s_elapsed", "s_cum_wait", "s_cum_processing", "d_wait_trend")
    rows = made.rows.collect()
    assert len(rows) == 20 and all(r["s_elapsed"] == 0.0 and r["d_wait_trend"] == 0.0 for r in rows)
    with pytest.raises(ValueError):
        entity_table(journeys.where("step > 0"), "wait_ratio_class", "entry_only")


def test_encoding(spark):
    few = spark.createDataFrame([(1.0,), (2.5,), (1.0,), (None,)], "y double")
    assert encoding_of(few, "y").names == ["1", "2.5"]
    many = spark.range(30).select(F.col("id").alias("y"))
    assert encoding_of(many, "y").task == "regression"
    wordy = encoding_of(many.select(F.col("y").cast("string")), "y")
    assert wordy.task == "classification" and wordy.names == sorted(str(i) for i in range(30))
    with pytest.raises(ValueError):
        encoding_of(many.select(F.array("y").alias("y")), "y")
