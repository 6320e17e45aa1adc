"""Records whose fields vary by row, and the fingerprint of maps."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.sources import open_records
from wayfold.sources.files import load
from wayfold.sources.layered_json import trajectories_layer
from wayfold.sources.store import content_hash

RECORDS = [
    {"entity_id": "a", "step_index": 0, "state": {"entity_elapsed_time": 1, "attr_tons": 7, "attr_kind": "ore"}, "reward": {"time_penalty": -1.5}},
    {"entity_id": "a", "step_index": 1, "state": {"entity_elapsed_time": 2.5, "resource_big_crane_capacity": 2}, "colour": "red"},
    {"entity_id": "b", "step_index": 0, "state": {"attr_kind": 3, "attr_open": True, "attr_parts": {"x": 1}}, "next_state": {"entity_elapsed_time": 9.0}},
    {"entity_id": "c", "state": None, "reward": "none"},
]


@pytest.fixture
def path(tmp_path):
    document = {"metadata": {"bucket": 60}, "snapshots": [{"timestamp": 1, "sys_wip": 4}, {"timestamp": 2, "node_dock_queue": 1}], "trajectories": RECORDS}
    path = tmp_path / "varying.json"
    path.write_text(json.dumps(document))
    return str(path)


def test_varying_records(spark, path):
    dataset = load(spark, path, varying=True)
    rows = {(r.eid, r.step): r.asDict() for r in dataset.trajectories.collect()}
    assert set(dataset.trajectories.columns) == {
        "eid", "step", "s_elapsed", "s_attr_tons", "s_attr_kind", "s_attr_open", "s_attr_parts", "s_r_big_crane_capacity", "rw_time_penalty", "ns_elapsed",
    }
    types = dict(dataset.trajectories.dtypes)
    assert (types["step"], types["s_elapsed"], types["s_attr_tons"], types["s_attr_kind"], types["s_attr_open"]) == ("bigint", "double", "bigint", "string", "boolean")
    assert rows["a", 0]["s_elapsed"] == 1.0 and rows["a", 1]["s_elapsed"] == 2.5 and rows["b", 0]["s_elapsed"] is None
    assert (rows["a", 0]["s_attr_kind"], rows["b", 0]["s_attr_kind"]) == ("ore", "3")
    assert rows["b", 0]["ns_elapsed"] == 9.0 and rows["a", 1]["s_r_big_crane_capacity"] == 2 and rows["a", 0]["rw_time_penalty"] == -1.5
    assert all(v is None for k, v in rows["c", None].items() if k != "eid")
    assert {(r.ts, r.wip, r.n_dock_queue) for r in dataset.snapshots.collect()} == {(1, 4, None), (2, None, 1)}
    assert json.loads(dataset.extras["metadata"]) == {"bucket": 60} and json.loads(dataset.extras["unknown_trajectory_fields"]) == ["colour"]


def test_varying_and_inferred_records_agree(spark, tmp_path):
    """Where one type holds a field's values, both readers give the same rows."""
    path = tmp_path / "same.json"
    records = [{"entity_id": f"e{i}", "step_index": i, "state": {"entity_elapsed_time": i / 2, **({"attr_size": i} if i % 3 else {})}} for i in range(20)]
    path.write_text(json.dumps({"trajectories": records}))
    inferred, varying = load(spark, str(path)).trajectories, load(spark, str(path), varying=True).trajectories
    assert dict(inferred.dtypes) == dict(varying.dtypes)
    assert inferred.exceptAll(varying.select(inferred.columns)).isEmpty() and varying.count() == 20


def test_map_state(spark):
    rows = [("a", {"entity_elapsed_time": 1.0, "attr_x.y": 2.0}), ("b", {"noise": 3.0}), ("c", None), ("d", {})]
    raw = spark.createDataFrame(rows, "entity_id string, state map<string,double>")
    layer = trajectories_layer(raw)
    assert layer.columns == ["eid", "s_attr_x.y", "s_elapsed"]
    assert [tuple(r) for r in layer.orderBy("eid").collect()] == [("a", 2.0, 1.0), ("b", None, None), ("c", None, None), ("d", None, None)]
    assert trajectories_layer(raw.where("entity_id = 'c'")).columns == ["eid"]


def test_too_many_names_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(open_records, "MAX_NAMES", 50)
    raw = spark.range(60).select(F.col("id").cast("string").alias("entity_id"), F.create_map(F.concat(F.lit("attr_"), "id"), F.lit(1.0)).alias("state"))
    with pytest.raises(ValueError, match="50 field names"):
        trajectories_layer(raw)
    assert len(trajectories_layer(raw.where("id < 50")).columns) == 51


def test_names_are_found_by_one_combined_aggregation(spark):
    """The shuffle holds a row for each name and task, not for each record."""
    raw = spark.range(0, 50_000, 1, 4).select(F.create_map(F.lit("attr_a"), F.col("id") * 1.0, F.lit("attr_b"), F.lit(1.0)).alias("state"))
    assert open_records.found_fields(raw, ["state"]) == {"state": {"attr_a": None, "attr_b": None}}


def test_fingerprint_of_maps(spark):
    def hashed(*rows):
        return content_hash(spark.createDataFrame([(r,) for r in rows], "m map<string,map<string,array<int>>>"))

    own = {"a": {"x": [1], "y": [2]}, "b": {}}
    turned = {"b": {}, "a": {"y": [2], "x": [1]}}
    assert hashed(own) == hashed(turned) != hashed({"a": {"x": [1], "y": [2]}})
    assert hashed({}) != hashed(None)
    deep = "s struct<k:int,m:map<int,string>>, a array<map<string,int>>"
    first = spark.createDataFrame([((1, {1: "a", 2: "b"}), [{"u": 1, "v": 2}])], deep)
    second = spark.createDataFrame([((1, {2: "b", 1: "a"}), [{"v": 2, "u": 1}])], deep)
    assert content_hash(first) == content_hash(second)
    variants = [spark.range(1).select(F.parse_json(F.lit(t)).alias("v")) for t in ('{"a": 1, "b": [2]}', '{"b": [2], "a": 1}', '{"a": 1}')]
    assert content_hash(variants[0]) == content_hash(variants[1]) != content_hash(variants[2])
