"""A document that many tasks read, against the reader of whole documents."""

import json
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from wayfold.catalog.sources import as_one_document
from wayfold.sources.files import load
from wayfold.sources.split_json import key_before, scanned, split_records, starts

TRICKY = ['plain', 'a } in { a string', 'quote \\" and brace }', '\\\\', '{"not": "an object"}', '], "trajectories": [{', "é🙂}", "line\nfeed}"]


def document(n, seed=1, indent=None):
    rng = random.Random(seed)
    state = lambda i: {"entity_elapsed_time": i / 4, "attr_kind": rng.choice(TRICKY), **({"attr_parts": {"deep": {"er": i}}} if i % 5 == 0 else {})}
    return json.dumps({
        "version": "2", "metadata": {"nodes": ["a", "b"], "note": "} {"}, "numbers": [1, 2, [3]],
        "snapshots": [{"timestamp": i, "sys_wip": i % 7} for i in range(n // 2)], "empty": {}, "none": [],
        "trajectories": [
            {"entity_id": rng.choice(TRICKY) + str(i), "step_index": i, "state": state(i), "reward": {"time_penalty": -1.0 * i}} for i in range(n)
        ],
        "summary": {"rows": n},
    }, indent=indent, ensure_ascii=seed % 2 == 0)


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that many records cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed, indent", [(1, None), (2, None), (3, 2)])
def test_equals_the_reader_of_whole_documents(spark, tmp_path, small_ranges, seed, indent):
    path = tmp_path / "one.json"
    path.write_text(document(60, seed, indent))
    assert len(starts(spark, str(path))) > 10
    whole, split = load(spark, str(path), varying=True), load(spark, str(path), split=True)
    for layer, df in whole.layers().items():
        other = split.layers()[layer]
        assert df.dtypes == other.dtypes
        assert sorted(map(str, df.collect())) == sorted(map(str, other.collect()))
    assert json.loads(split.extras["metadata"]) == json.loads(whole.extras["metadata"])


def test_records_longer_than_ranges_and_several_files(spark, tmp_path, small_ranges):
    folder = tmp_path / "many.json"
    folder.mkdir()
    for i in range(3):
        records = [{"entity_id": f"{i}-{k}", "step_index": k, "state": {"attr_text": ("x}" * 1_500 if k == 2 else "y") + "\\\"{"}} for k in range(5)]
        (folder / f"{i}.json").write_text(json.dumps({"trajectories": records}))
    rows = {r.eid: r.s_attr_text for r in load(spark, str(folder), split=True).trajectories.collect()}
    assert len(rows) == 15 and rows["1-2"] == "x}" * 1_500 + "\\\"{" and rows["2-0"] == "y\\\"{"


def test_records_by_key(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(document(9))
    found = split_records(spark, str(path))
    counts = {(r.layer, r.in_array): r.n for r in found.groupBy("layer", "in_array").agg(F.count("*").alias("n")).collect()}
    assert counts == {("metadata", False): 1, ("snapshots", True): 4, ("empty", False): 1, ("trajectories", True): 9, ("summary", False): 1}


def test_pieces():
    assert scanned('{"a": "{", "b": {', False) == ([0, 16], False)
    assert scanned('still } in" , {', True) == ([14], False)
    assert scanned('"open \\" ', False) == ([], True)
    assert key_before('], "k" : [ {', 11, 0) == ("k", True) and key_before(", {", 2, 0) is None and key_before('"m":{', 4, 0) == ("m", False)


def test_a_document_is_written_without_sorting_it(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.text

    def watched(self, path, *rest, **named):
        plans.append(self._df._jdf.queryExecution().toString())
        return write(self, path, *rest, **named)

    monkeypatch.setattr(DataFrameWriter, "text", watched)
    layers = {
        "first": spark.range(5_000, numPartitions=7).select("id", F.lit('a } " {').alias("text")), "none": spark.range(0).select("id"),
        "last": spark.range(3_000, numPartitions=3).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")),
    }
    as_one_document(str(tmp_path / "one.json"), layers)
    assert len(plans) == 1 and not any(step in plans[0] for step in ("Sort", "Window", "Exchange"))
    (file,) = (tmp_path / "one.json").glob("part-*")
    found = json.loads(file.read_text())
    assert list(found) == ["metadata", "first", "none", "last"]
    assert sorted(r["id"] for r in found["first"]) == list(range(5_000)) and {r["text"] for r in found["first"]} == {'a } " {'}
    assert found["none"] == [] and sorted(r.get("even", -1) for r in found["last"]) == [-1] * 1_500 + list(range(0, 3_000, 2))
