import pytest
from pyspark.sql import functions as F

from wayfold.functions import encode
from wayfold.functions.encode import encoding_of
from wayfold.operators.classes import attach, class_table, with_weights
from wayfold.operators.folds import balanced_weights, positive_weight


def kinds(spark):
    """A hot class with a third of the rows, rows without a class, and many rare ones, some of which share their first letters."""
    values = ["hot"] * 400 + [None] * 40 + [f"kindred-{i % 300:04d}" for i in range(700)] + ["", "é", "z"]
    return spark.createDataFrame(list(enumerate(values)), "id int, kind string").coalesce(2)


@pytest.mark.parametrize("split", [False, True])
def test_numbers_follow_the_order_of_the_classes(spark, split):
    df = kinds(spark)
    want = sorted({r["kind"].encode() for r in df.where("kind is not null").collect()})
    got = class_table(df, "kind", rows_per_block=50, split=split).orderBy("number").collect()
    assert [r["class"].encode() for r in got] == want and [r["number"] for r in got] == list(range(len(want)))
    assert sum(r["rows"] for r in got) == 1103


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_every_row_gets_its_class(spark, most):
    df = kinds(spark).withColumn("_place", F.lit("mine")).withColumn("label", F.lit(-5))
    classes = with_weights(class_table(df, "kind"))
    known = {r["class"]: r for r in classes.collect()}
    rows = attach(df, "kind", classes, {"label": "number", "weight": "weight"}, broadcast_classes=most).collect()
    assert len(rows) == df.count() and all(r["_place"] == "mine" for r in rows)
    for r in rows:
        want = known.get(r["kind"])
        assert (r["label"], r["weight"]) == ((want["number"], want["weight"]) if want else (None, None))
    assert known["hot"]["weight"] == pytest.approx(1103 / (len(known) * 400))


def test_encoding_of_many_classes_is_a_table(spark, monkeypatch):
    df = kinds(spark)
    listed = encoding_of(df, "kind")
    monkeypatch.setattr(encode, "LISTED_CLASSES", 10)
    stored = encoding_of(df, "kind")
    assert stored.task == "classification" and stored.classes is None and stored.rows == listed.rows == 1103
    plain = lambda e: sorted((r["id"], r["label"]) for r in e.add(df, "kind", "label").where("kind is not null").collect())
    assert plain(stored) == plain(listed)
    with pytest.raises(ValueError, match="no expression"):
        stored.column("kind")


def test_a_hundred_thousand_classes(spark):
    df = spark.range(200_000).select((F.col("id") % 100_000).cast("string").alias("kind"))
    encoding = encoding_of(df, "kind")
    assert encoding.classes is None
    found = encoding.add(df, "kind", "label").agg(F.countDistinct("label"), F.min("label"), F.max("label")).first()
    assert tuple(found) == (100_000, 0, 99_999)


def test_weights_without_classes(spark):
    empty = spark.createDataFrame([], "c string, x int")
    assert balanced_weights(empty, "c").columns == ["c", "x", "weight"] and balanced_weights(empty, "c").count() == 0
    only_null = spark.createDataFrame([(None, 1)], "c string, x int")
    assert [r["weight"] for r in balanced_weights(only_null, "c").collect()] == [1.0]
    labels = spark.createDataFrame([(0,), (0,), (1,), (None,), (2,)], "y int")
    assert sorted((str(r["y"]), r["weight"]) for r in positive_weight(labels, "y").collect()) == [("0", 1.0), ("0", 1.0), ("1", 2.0), ("2", 1.0), ("None", 1.0)]
