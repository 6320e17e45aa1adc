"""Trees grown inside one task are those that pyspark.ml grows by many jobs."""

import uuid

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from wayfold.functions.encode import Encoding
from wayfold.plans.draws import map_order
from wayfold.plans.entity import FeatureTable
from wayfold.plans.training import Trainer
from wayfold.plans.trees import fit_in_a_task, fits_a_task, plan_of, predict_in_a_task

NAMES = ["a", "b", "c", "z", "e"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Ties, zeros, a constant column, weights, and two partitions."""
    path = str(tmp_path_factory.mktemp("trees") / "rows")
    n = F.col("id")
    spark.range(0, 500, 1, 2).select(
        "id", F.sin("id").alias("a"), F.cos(n * 3).alias("b"), (n % 7).cast("double").alias("c"), F.lit(0.0).alias("z"),
        F.when(n % 3 == 0, 0.0).otherwise(F.xxhash64("id") % 1000 / 7).alias("e"), (F.sin(n * 5) + n % 5).alias("label"),
        F.pmod(F.xxhash64(n + 5), F.lit(3)).cast("double").alias("class"), F.pmod(F.xxhash64(n + 5), F.lit(2)).cast("double").alias("two"), (n % 4 * 0.37 + 0.2).alias("weight"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("make", [
    lambda: GBTRegressor(maxIter=8, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=3405691582, minInstancesPerNode=3),
    lambda: GBTClassifier(labelCol="two", weightCol="weight", maxIter=4, maxDepth=5, subsamplingRate=0.7, seed=3405691582),
    lambda: RandomForestRegressor(numTrees=9, maxDepth=7, featureSubsetStrategy="log2", seed=7),
    lambda: RandomForestClassifier(labelCol="class", weightCol="weight", numTrees=9, maxDepth=9, featureSubsetStrategy="sqrt", seed=5, maxMemoryInMB=1, minInstancesPerNode=2),
], ids=["boosting", "binary", "forest", "classes"])
def test_same_trees_in_one_task(rows, make):
    estimator = make()
    vectors = rows.select(array_to_vector(F.array(*NAMES)).alias("features"), "label", "class", "two", "weight").coalesce(2)
    plan, columns = plan_of(estimator), [F.col(c) for c in NAMES]
    many, one = estimator.fit(vectors), fit_in_a_task(estimator, plan, rows, columns, 2)
    assert many.toDebugString == one.toDebugString
    assert many.featureImportances == one.featureImportances and one.getMaxDepth() == estimator.getMaxDepth()
    if not plan.classify:
        held = rows.where("id % 9 = 0").coalesce(1)
        found = predict_in_a_task(estimator, plan, rows, held, columns, 2).collect()
        said = many.transform(held.select(array_to_vector(F.array(*NAMES)).alias("features"))).collect()
        assert [r.y_pred for r in found] == pytest.approx([r.prediction for r in said]) and len(found) == 56


def test_more_than_a_task_holds_is_left_to_many(rows):
    plan = plan_of(RandomForestRegressor(numTrees=300))
    assert fits_a_task(plan, 600, 16) and not fits_a_task(plan, 1_500_000, 9)
    assert plan_of(GBTRegressor(validationIndicatorCol="held")) is None and plan_of(GBTRegressor(lossType="absolute")) is None


def test_maps_are_walked_as_scala_does():
    assert map_order([19, 3, 0]) == [0, 3, 19]
    assert sorted(map_order(list(range(300)))) == list(range(300)) and map_order(list(range(300))) != list(range(300))


def jobs_of(spark, run):
    """Jobs begun while something runs, in whatever group: their numbers follow each other."""
    context = spark.sparkContext

    def last():
        group = uuid.uuid4().hex
        context.setJobGroup(group, "a job to see its number")
        spark.range(1).rdd.count()
        return max(context.statusTracker().getJobIdsForGroup(group))

    before = last()
    run()
    return last() - before - 1


def test_jobs_do_not_grow_with_rounds(spark, rows):
    table = FeatureTable(rows.select("id", *NAMES, "label"), ("id",), tuple(NAMES), "label", Encoding("regression"))
    trainer = Trainer(table, ["rmse"], "shuffled", 2, parallel=2, settings={"gbt": {"maxIter": 30, "maxDepth": 3}})
    trainer.trials("gbt", 1)
    assert jobs_of(spark, lambda: trainer.trials("gbt", 2)) <= 12  # some 400 when each level was a job
    assert jobs_of(spark, lambda: trainer.cross_validate("gbt")) <= 40
