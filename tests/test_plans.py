"""Series features, training, experiments and streams."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wayfold.functions.encode import Encoding
from wayfold.functions.features import FeatureDefinition, FeatureStore
from wayfold.operators.series import bucket_interval
from wayfold.plans.entity import FeatureTable
from wayfold.plans.experiment import Experiment, run_experiment
from wayfold.plans.learners import SPACES, Facts, Learner, Learners, default_learners, sample_settings
from wayfold.plans.models import ModelStore
from wayfold.plans.series import series_table
from wayfold.plans.training import Trainer, predict
from wayfold.sources.store import ExperimentLog
from wayfold.streaming.scoring import append_to, scored_stream


@pytest.fixture(scope="module")
def hourly(spark):
    draw = random.Random(2)
    rows = [(300.0 * (i + 1), i + 1, draw.randrange(9), draw.randrange(5), draw.random(), draw.randrange(4), draw.randrange(4)) for i in range(120)]
    return spark.createDataFrame(rows, "ts double, bucket_idx int, in_queue int, busy int, avg_wait double, n_a_queue int, n_b_queue int")


OPTIONS = dict(lookback="20m", horizon="5m", lags=("5m", "10m"), rolling=("10m",))


def test_series_values(hourly):
    made = series_table(hourly, **OPTIONS)
    raw = hourly.orderBy("ts").toPandas()
    got = made.rows.orderBy("ts").toPandas()
    assert list(got["ts"]) == list(raw["ts"][3:-1])
    x = raw["in_queue"].to_numpy(float)
    i = 57
    row = got[got["ts"] == raw["ts"][i]].iloc[0]
    assert row["in_queue_lag_5m"] == x[i - 1] and row["in_queue_lag_10m"] == x[i - 2]
    assert row["in_queue_rmean_10m"] == pytest.approx(x[i - 1 : i + 1].mean())
    assert row["in_queue_rstd_10m"] == pytest.approx(x[i - 1 : i + 1].std(ddof=1))
    assert row["in_queue_trend"] == pytest.approx(np.polyfit(range(4), x[i - 3 : i + 1], 1)[0])
    assert row["label"] == raw["avg_wait"][i + 1]
    a, b = raw["n_a_queue"][i], raw["n_b_queue"][i]
    assert row["queue_imbalance"] == pytest.approx(max(a, b) / ((a + b) / 2) if a + b else 1.0)
    assert row["queue_to_busy_ratio"] == pytest.approx(x[i] / raw["busy"][i] if raw["busy"][i] else 0.0)
    assert not any(c.startswith(("bucket_idx", "avg_wait_lag")) for c in made.features)


def test_series_names_come_in_order(hourly):
    made = series_table(hourly, columns=["in_queue", "busy"], **OPTIONS)
    assert made.features == (
        "in_queue_lag_5m", "in_queue_lag_10m", "busy_lag_5m", "busy_lag_10m", "in_queue_rmean_10m", "in_queue_rstd_10m",
        "busy_rmean_10m", "busy_rstd_10m", "in_queue_trend", "busy_trend", "queue_to_busy_ratio")


def test_gaps_inside_a_frame_give_null(hourly):
    holed = hourly.withColumn("in_queue", F.when(F.col("bucket_idx") != 50, F.col("in_queue")))
    kept = series_table(holed, columns=["in_queue"], **OPTIONS).rows
    gone = {r["ts"] for r in series_table(hourly, columns=["in_queue"], **OPTIONS).rows.collect()} - {r["ts"] for r in kept.collect()}
    assert gone == {300.0 * k for k in (50, 51, 52, 53)}


def test_interval(spark, hourly):
    assert bucket_interval(hourly) == bucket_interval(hourly.withColumn("ts", F.timestamp_seconds("ts")))
    with pytest.raises(ValueError):
        bucket_interval(hourly.limit(1))
    with pytest.raises(ValueError):
        bucket_interval(spark.createDataFrame([(1.0,), (1.0,)], "ts double"))
    with pytest.raises(ValueError):
        bucket_interval(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "ts double"), on_gap="error")


def test_feature_store():
    store = FeatureStore()
    store.register(FeatureDefinition("a", "x", "lag", {"duration": "1h"}))
    assert store.has("a") and store.reach(["a"], 600) == 6 and len(store.definitions()) == 1
    with pytest.raises(KeyError):
        store.get("b")
    with pytest.raises(ValueError):
        store.register(FeatureDefinition("c", "x", "magic"))
    with pytest.raises(ValueError):
        store.get("a").column()


@pytest.fixture(scope="module")
def cloud(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 3))
    return x, draw.normal(scale=0.1, size=200)


def regression(spark, cloud):
    x, noise = cloud
    y = 2 * x[:, 0] + x[:, 1] + noise
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double")
    return FeatureTable(df, ("id",), ("a", "b", "c"), "label", Encoding("regression"))


def test_linear_is_ridge(spark, cloud):
    table = regression(spark, cloud)
    trainer = Trainer(table, ["rmse"], "shuffled", 2)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {"alpha": 3.0})
    x, noise = cloud
    y = 2 * x[:, 0] + x[:, 1] + noise
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 3.0 * np.eye(3), centred.T @ (y - y.mean()))
    assert np.allclose(fitted.model.coefficients.toArray(), expected, atol=1e-6)


def test_run_ranks_and_refits(spark, cloud, tmp_path):
    trainer = Trainer(regression(spark, cloud), ["rmse", "r2"], "shuffled", 2, settings={"random_forest": {"numTrees": 3, "maxDepth": 3}})
    outcome = trainer.run(["random_forest", "linear", "nothing"])
    assert outcome.best.learner == "linear" and set(outcome.skipped) == {"nothing"}
    assert [r["algorithm"] for r in outcome.ranking.orderBy("rank").collect()] == ["linear", "random_forest"]
    assert outcome.importance.orderBy("rank").first()["feature"] == "a"
    assert outcome.train_metrics["r2"] > 0.95
    assert sorted(r["id"] for r in outcome.out_of_fold.collect()) == list(range(200))
    models = ModelStore(spark, str(tmp_path))
    models.save("m1", outcome.best, "e1", {"rmse": 1.0})
    again = predict(trainer.rows, models.load("m1")).agg(F.sum("predicted")).first()[0]
    assert again == pytest.approx(outcome.predictions.agg(F.sum("y_pred")).first()[0])
    assert [r["id"] for r in models.models().collect()] == ["m1"]
    models.delete("m1")
    with pytest.raises(KeyError):
        models.load("m1")


def test_all_failing_is_an_error(spark, cloud):
    with pytest.raises(RuntimeError):
        Trainer(regression(spark, cloud), ["rmse"], "shuffled", 2).run(["nothing"])


def test_classes_and_missing_columns(spark, cloud):
    x, _ = cloud
    rows = [(i, *map(float, r), int(r[0] + r[1] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int")
    table = FeatureTable(df, ("id",), ("a", "b", "c"), "label", Encoding("classification", ("no", "yes"), 200))
    trainer = Trainer(table, ["auc_roc", "accuracy"], "stratified", 2)
    values = {(f, m): v for _, f, m, v in trainer.cross_validate("linear")}
    assert min(values.values()) > 0.85
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {})
    scored = predict(spark.createDataFrame([(3.0,), (-3.0,), (None,)], "a double"), fitted).collect()
    assert [r["predicted"] for r in scored[:2]] == ["yes", "no"]
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in scored)
    stream_path = trainer.rows.inputFiles()[0].rsplit("/", 1)[0]
    assert stream_path


def test_search_space_draws_repeat():
    for name, space in SPACES.items():
        draws = sample_settings(space, 5, 1)
        assert draws == sample_settings(space, 5, 1) and draws != sample_settings(space, 5, 2)
        assert all(set(d) == set(space) for d in draws)
    assert all(3 <= d["maxDepth"] <= 10 and 0.01 <= d["stepSize"] <= 0.3 for d in sample_settings(SPACES["gbt"], 50, 3))
    learners = default_learners()
    with pytest.raises(ValueError):
        learners.register(Learner("gbt", lambda *a: None))


def test_experiment_is_recorded(spark, hourly, tmp_path):
    log, models = ExperimentLog(spark, str(tmp_path)), ModelStore(spark, str(tmp_path))
    run = Experiment(target="avg_wait", algorithms=("linear",), folds=2, columns=("in_queue", "busy"), gap_to_test=True, **OPTIONS)
    result = run_experiment(hourly, run, log, models)
    assert result.status == "completed", result.error
    record = log.get(result.experiment_id)
    assert record["status"] == "completed" and set(record["metrics"]) == {"rmse", "mae", "mape"}
    assert models.load(result.model_id).learner == "linear"


def test_failed_checks_end_in_a_failed_record(spark, hourly, tmp_path):
    log = ExperimentLog(spark, str(tmp_path))
    result = run_experiment(hourly.limit(20), Experiment(target="avg_wait", algorithms=("linear",), **OPTIONS), log)
    assert result.status == "failed" and "V-02" in result.error
    assert log.get(result.experiment_id)["status"] == "failed"
    broken = run_experiment(hourly, Experiment(target="avg_wait", algorithms=("linear",), lookback="soon"), None)
    assert broken.status == "failed" and "duration" in broken.error


def test_stream_and_batch_score_alike(spark, cloud, tmp_path):
    trainer = Trainer(regression(spark, cloud), ["rmse"], "shuffled", 2)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {})
    source = str(tmp_path / "in")
    rows = trainer.rows.select("id", "a", "b")
    rows.repartition(3).write.parquet(source)
    stream = scored_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), fitted, "m")
    query = append_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("id", "predicted")
    batch = predict(rows, fitted).select("id", "predicted")
    assert streamed.count() == 200 and streamed.exceptAll(batch).isEmpty()


def test_defaults_reach_the_estimators():
    """What the full queries fit: nothing is set but the defaults."""
    learners, facts = default_learners(), Facts(1_000, 1.0, 2)
    for task in ("regression", "classification"):
        boosting = learners.get("lightgbm").build(task, facts, 7, {}, None)
        assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getStepSize(), boosting.getCheckpointInterval()) == (500, 6, 0.05, 10)
        assert not boosting.isSet("validationIndicatorCol")
        forest = learners.get("random_forest").build(task, facts, 7, {}, None)
        assert (forest.getNumTrees(), forest.getMaxDepth()) == (300, 12)
    many = learners.get("gbt").build("classification", Facts(1_000, 1.0, 3), 7, {}, "held")
    assert many.getClassifier().getMaxIter() == 500 and not many.getClassifier().isSet("validationIndicatorCol")


SMALL = {"gbt": {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1}, "random_forest": {"numTrees": 3}}


@pytest.mark.parametrize("name", ["gbt", "random_forest"])
def test_trials_and_folds_are_one_queue(spark, cloud, name):
    """Many at a time or one by one: the same values and the same winner, which is what cross-validation of each draw says."""
    def trainer(parallel):
        return Trainer(regression(spark, cloud), ["rmse"], "shuffled", 3, settings=SMALL, parallel=parallel)

    many = trainer(6)
    found = many.trials(name, 4)
    assert len(found) == 4 and found == trainer(1).trials(name, 4)
    best = min(found, key=lambda t: t[1])[0]
    assert many.search(name, 4) == best
    values = [v for *_, v in many.cross_validate(name, best)]
    assert sum(values) / 3 == pytest.approx(min(v for _, v in found))


def test_a_failing_trial_leaves_the_others(spark, cloud):
    def build(task, facts, seed, settings, held=None):
        if settings["alpha"] > 1.0:
            raise RuntimeError("no such fit")
        return default_learners().get("linear").build(task, facts, seed, settings)

    learners = Learners()
    learners.register(Learner("fragile", build, space=lambda task: {"alpha": ("log", 1e-4, 1e4)}))
    learners.register(Learner("broken", build, space=lambda task: {"alpha": ("float", 2.0, 3.0)}))
    trainer = Trainer(regression(spark, cloud), ["rmse"], "shuffled", 2, learners=learners)
    found = trainer.trials("fragile", 8)
    assert {m is None for _, m in found} == {True, False}
    assert all((m is None) == (s["alpha"] > 1.0) for s, m in found)
    assert trainer.search("fragile", 8)["alpha"] <= 1.0
    with pytest.raises(RuntimeError, match="no such fit"):
        trainer.search("broken", 2)
    outcome = trainer.run(["broken", "fragile"], trials=8)
    assert outcome.best.learner == "fragile" and list(outcome.skipped) == ["broken"]


def test_boosting_can_stop_early_and_checkpoints(spark, cloud):
    trainer = Trainer(regression(spark, cloud), ["rmse"], "shuffled", 2)
    boosting = trainer.learners.get("gbt")
    settings = {"maxIter": 30, "maxDepth": 2, "stepSize": 0.5, "subsamplingRate": 1.0}
    every = trainer.fit(boosting, trainer.rows, settings)
    stopped = trainer.fit(boosting, trainer.rows, {**settings, "early_stop": 0.3})
    assert every.model.getNumTrees == 30 and stopped.model.getNumTrees < 30
    assert spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_forests_keep_node_ids_and_grow_the_same_trees(spark, task):
    """Levels do not walk the trees again, which changes no tree."""
    rows = spark.range(0, 400, 1, 3).select(F.array(F.sin("id"), F.cos(F.col("id") * 3), F.col("id") % 7.0).alias("x"), (F.col("id") * 7 % 3).cast("double").alias("label"))
    rows = rows.select(array_to_vector("x").alias("features"), "label", F.lit(1.0).alias("weight")).persist()
    forest = default_learners().get("random_forest").build(task, Facts(400, 1.0, 3), 7, {"numTrees": 4, "maxDepth": 6}, None)
    assert forest.getCacheNodeIds()
    kept, walked = (forest.copy({forest.cacheNodeIds: held}).fit(rows) for held in (True, False))
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]
    rows.unpersist()


def test_out_of_fold_rows_are_scored_once(spark, cloud):
    trainer = Trainer(regression(spark, cloud), ["rmse"], "shuffled", 3)
    scores = {f: v for _, f, _, v in trainer.cross_validate("linear")}
    kept = trainer.out_of_fold("linear")
    assert kept.count() == trainer.rows.count()
    for r in kept.groupBy("fold").agg(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2)).alias("rmse")).collect():
        assert r.rmse == pytest.approx(scores[r.fold])
    assert "Arrow" not in kept._jdf.queryExecution().executedPlan().toString() and "UDF" not in kept._jdf.queryExecution().executedPlan().toString()
