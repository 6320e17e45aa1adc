"""Readers, the name rules, profiles, quality and the stores."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.functions.durations import seconds, steps
from wayfold.functions.hashing import named_seed
from wayfold.model import Dataset
from wayfold.operators.discovery import entity_targets, problem_type, series_targets
from wayfold.operators.profile import column_profile, full_profile
from wayfold.operators.quality import constant_columns, duplicate_rows, missing_rates, quality_report
from wayfold.sources.event_tables import snapshots_from, trajectories_from
from wayfold.sources.files import TIME_NAMES, layer_of, load, load_csv
from wayfold.sources.layered_json import load_layered_json, reward_name, snapshot_name, state_name, trajectory_name
from wayfold.sources.store import DatasetStore, ExperimentLog, content_hash, preview


@pytest.fixture
def export(tmp_path):
    document = {
        "metadata": {"bucket": 60, "nodes": ["dock", "gate"]},
        "state_snapshots": [
            {"timestamp": 120, "bucket_index": 2, "sys_wip": 4, "node_dock_queue": 1, "resource_crane_utilization": 0.5, "node_dock_mood": 1},
            {"timestamp": 60, "bucket_index": 1, "sys_wip": 2, "node_dock_queue": 0, "resource_crane_utilization": 0.25, "weather": "wet"},
        ],
        "trajectories": [
            {"entity_id": "s1", "step_index": 0, "episode_done": False, "sla_limit": 90, "domain_kind": "port", "noise": 1,
             "state": {"entity_elapsed_time": 0.0, "resource_big_crane_capacity": 2, "attr_tons": 7},
             "reward": {"time_penalty": -1.0, "fame": 3}, "next_state": {"entity_elapsed_time": 9.0}},
            {"entity_id": "s1", "step_index": 1, "episode_done": True, "episode_total_time": 80.0, "sla_limit": 90,
             "state": {"entity_elapsed_time": 9.0}, "reward": {"time_penalty": -2.0}},
        ],
    }
    path = tmp_path / "export.json"
    path.write_text(json.dumps(document))
    return str(path)


def test_layered_json(spark, export):
    dataset = load(spark, export)
    assert set(dataset.snapshots.columns) == {"ts", "bucket_idx", "wip", "n_dock_queue", "r_crane_util"}
    assert [r["ts"] for r in dataset.snapshots.orderBy("ts").collect()] == [60, 120]
    assert set(dataset.trajectories.columns) == {
        "eid", "step", "done", "total_time", "sla_limit", "domain_kind", "s_elapsed", "s_r_big_crane_capacity", "s_attr_tons",
        "rw_time_penalty", "ns_elapsed",
    }
    last = dataset.trajectories.where("step = 1").first()
    assert last["s_attr_tons"] is None and last["ns_elapsed"] is None and last["total_time"] == 80.0
    assert json.loads(dataset.extras["metadata"])["bucket"] == 60


def test_layered_json_without_layers(spark, tmp_path):
    path = tmp_path / "empty.json"
    path.write_text('{"metadata": {"a": 1}, "snapshots": []}')
    with pytest.raises(ValueError):
        load_layered_json(spark, str(path))


def test_name_rules():
    assert snapshot_name("sys_avg_wait_time") == "avg_wait"
    assert snapshot_name("node_qc_avg_processing_time") == "n_qc_avg_processing"
    assert snapshot_name("node_qc_colour") is None and snapshot_name("node__queue") is None
    assert trajectory_name("transport_cost") == "transit_cost" and trajectory_name("sla_x") == "sla_x"
    assert trajectory_name("attr_weight") is None
    assert state_name("node_max_queue_depth", "ns") == "ns_node_max_queue"
    assert state_name("resource_a_b_utilization") == "s_r_a_b_util" and state_name("attr_x_y") == "s_attr_x_y"
    assert state_name("attr_") is None and reward_name("sla_penalty") == "rw_sla_penalty" and reward_name("x") is None


def test_csv_kinds(spark, tmp_path):
    (tmp_path / "series.csv").write_text("Timestamp,a\n1,2.5\n2,3.5\n")
    (tmp_path / "things.csv").write_text("item,score\nx,1\ny,2\n")
    (tmp_path / "none.csv").write_text("item,score\n")
    assert load(spark, str(tmp_path / "series.csv")).trajectories is None
    things = load_csv(spark, str(tmp_path / "things.csv"), {"item": "eid"}).trajectories
    assert things.columns == ["eid", "score"] and things.agg(F.sum("score")).first()[0] == 3
    with pytest.raises(ValueError):
        load_csv(spark, str(tmp_path / "none.csv"))


def test_every_time_name_marks_a_series(spark):
    for name in TIME_NAMES:
        assert layer_of(spark.createDataFrame([(1, 2)], f"`{name.upper()}` int, v int")) == "snapshots"
    assert layer_of(spark.createDataFrame([(1, 2)], "id int, v int")) == "trajectories"
    assert layer_of(spark.sql("select date'2024-01-01' as d")) == "snapshots"


def test_durations():
    assert [seconds(t) for t in ("30s", "5m", "1.5h", "1d", " 2H ")] == [30, 300, 5400, 86400, 7200]
    for bad in ("", "5", "h", "-1h", "1w"):
        with pytest.raises(ValueError):
            seconds(bad)
    assert steps("1h", 300) == 12 and steps("1m", 300) == 1 and steps("1m", 300, 2) == 2


def test_named_seed_depends_on_name_and_seed():
    assert named_seed("gbt", 42) == named_seed("gbt", 42)
    assert len({named_seed("gbt", 42), named_seed("gbt", 43), named_seed("linear", 42)}) == 3


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "b", True), (None, "a", None), (4.0, "b", False)], "x double, c string, f boolean")
    rows = {r["name"]: r for r in full_profile(df).collect()}
    assert rows["x"]["null_count"] == 1 and rows["x"]["null_rate"] == 0.333333 and rows["x"]["unique_count"] == 3
    assert rows["x"]["mean"] == 2.5 and rows["x"]["std"] == 2.12132 and rows["x"]["categories"] is None
    assert rows["c"]["categories"] == ["a", "b"] and rows["c"]["category_counts"] == {"a": 1, "b": 2}
    assert not rows["f"]["is_numeric"] and rows["f"]["unique_count"] == 3
    single = column_profile(spark.createDataFrame([(5,)], "x int")).first()
    assert single["std"] is None and single["mean"] == 5.0
    nothing = column_profile(spark.createDataFrame([], "x int")).first()
    assert nothing["null_rate"] == 0.0 and nothing["unique_count"] == 0 and nothing["mean"] is None


def test_sketch_counts_small_sets_exactly(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("x"))
    assert column_profile(df, exact=False).first()["unique_count"] == 7


def test_quality(spark):
    df = spark.createDataFrame([(1, 1, None), (None, 1, None), (None, 1, None), (None, 1, None), (5, 1, None)], "a int, b int, c int")
    assert {r["column"]: (r["missing_rate"], r["issue"]) for r in missing_rates(df).collect()} == {
        "a": (0.6, True), "b": (0.0, False), "c": (1.0, True)}
    assert {r["column"]: r["constant"] for r in constant_columns(df).collect()} == {"a": False, "b": True, "c": True}
    copies = duplicate_rows(spark.createDataFrame([(x,) for x in (1, 1, 1, 1, 2, 3)], "x int")).first()
    assert (copies["duplicate_count"], copies["duplicate_rate"]) == (3, 0.5)
    empty = duplicate_rows(spark.createDataFrame([], "x int")).first()
    assert (empty["row_count"], empty["duplicate_count"], empty["duplicate_rate"]) == (0, 0, 0.0)
    report = quality_report(df).collect()
    assert {(r["kind"], r["column"]) for r in report if r["level"] != "info"} == {
        ("size", None), ("missing", "a"), ("missing", "c"), ("constant", "b"), ("constant", "c"), ("duplicates", None)}


def test_discovery(spark):
    rows = spark.createDataFrame([(1, 2, 3.0, "x")], "ts int, wip int, avg_wait double, note string")
    found = {r["column"]: r["is_default"] for r in series_targets(column_profile(rows)).collect()}
    assert found == {"wip": False, "avg_wait": True}
    other = series_targets(column_profile(rows.drop("avg_wait")))
    assert [r["is_default"] for r in other.collect()] == [True]
    assert entity_targets(spark.createDataFrame([(1,)], "x int")).isEmpty()
    assert problem_type(None, None, True, True) == "time_series"
    assert problem_type(None, "trajectories", True, True) == "entity_classification"
    assert problem_type(None, None, False, True) == "entity_classification"
    assert problem_type("time_series", "trajectories", False, True) == "time_series"


def test_store(spark, export, tmp_path):
    store = DatasetStore(spark, str(tmp_path / "store"))
    assert store.datasets().isEmpty()
    first = store.register(load(spark, export), "port")
    assert store.exists(first) and len(first) == 12
    assert store.read(first, "snapshots").count() == 2
    assert store.profile(first, "trajectories").where("name = 'eid'").first()["unique_count"] == 1
    with pytest.raises(ValueError):
        store.read(first, "shadows")
    second = store.register(Dataset(trajectories=spark.createDataFrame([("a", 1)], "eid string, step int")), "other")
    with pytest.raises(ValueError):
        store.read(second, "snapshots")
    assert [r["name"] for r in store.datasets().collect()] == ["port", "other"]
    store.delete(first)
    assert not store.exists(first) and store.exists(second)
    with pytest.raises(KeyError):
        store.read(first, "snapshots")
    with pytest.raises(ValueError):
        Dataset()


def test_content_hash_ignores_row_order(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("v"))
    assert content_hash(df) == content_hash(df.orderBy(F.desc("id")).repartition(3))
    assert content_hash(df) != content_hash(df.where("id < 99"))


def test_preview(spark):
    rows, total = preview(spark.range(500).toDF("id"), 5, ["id"])
    assert [r["id"] for r in rows.collect()] == [0, 1, 2, 3, 4] and total == 500
    with pytest.raises(ValueError):
        preview(spark.range(5).toDF("id"), 101, ["id"])


def test_experiment_log(spark, tmp_path):
    log = ExperimentLog(spark, str(tmp_path))
    log.create("a", "first", {"problem_type": "time_series"})
    log.create("b", "second", {"problem_type": "entity_classification"})
    log.set_status("a", "running")
    log.save_result("a", "completed", {"rmse": 1.5}, {"best": "linear"})
    state = {r["experiment_id"]: r for r in log.experiments().collect()}
    assert state["a"]["status"] == "completed" and state["a"]["metrics"] == {"rmse": 1.5} and state["a"]["name"] == "first"
    assert [r["experiment_id"] for r in log.experiments().collect()] == ["b", "a"]
    assert [r["experiment_id"] for r in log.experiments("time_series").collect()] == ["a"]
    assert json.loads(log.get("a")["result"]) == {"best": "linear"}
    with pytest.raises(ValueError):
        log.create("a", "again", {})
    with pytest.raises(KeyError):
        log.set_status("zzz", "failed")


def test_snapshots_fill_empty_buckets(spark):
    events = spark.sql("""
        SELECT * FROM VALUES (1L, timestamp_ntz'2024-01-01 00:10:00', 7L, 'click', 4.0D), (2L, timestamp_ntz'2024-01-01 00:50:00', 7L, 'view', 6.0D),
          (3L, timestamp_ntz'2024-01-01 03:00:00', 8L, 'view', 1.0D) AS t(event_id, ts, user_id, event_type, value)""")
    rows = snapshots_from(events).orderBy("ts").collect()
    assert [(r["arrivals"], r["busy"], r["in_queue"], r["avg_wait"]) for r in rows] == [(2, 1, 1, 5.0), (0, 0, 0, 0.0), (0, 0, 0, 0.0), (1, 0, 1, 1.0)]
    assert snapshots_from(events.where("false")).isEmpty()
    journeys = {(r["eid"], r["step"]): r for r in trajectories_from(events).collect()}
    assert journeys["7-2024-01-01", 1]["wait"] == 2400.0 and journeys["7-2024-01-01", 1]["total_time"] == 2400.0 + 600.0
    assert not journeys["7-2024-01-01", 0]["done"] and journeys["8-2024-01-01", 0]["done"]


def test_scratch_is_removed_on_request(spark):
    from pathlib import Path

    from wayfold.session import cut_lineage, remove_scratch, scratch_mark

    mark = scratch_mark()
    kept = cut_lineage(spark.range(3).toDF("x"), "kept")
    path = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists() and remove_scratch(spark, mark) == 1 and not path.exists()


def test_documents_hold_whole_tables(spark, tiny):
    from wayfold.catalog.entry import plain_journeys
    from wayfold.catalog.sources import many_documents
    from wayfold.sources.event_tables import snapshots

    assert many_documents("snapshots")(spark, tiny).count() == snapshots(spark, tiny).count()
    assert many_documents("trajectories")(spark, tiny).count() == plain_journeys(spark, tiny).count()
