"""Fits on feature tables: with small settings, and for each learner with the default ones (``learn_full_...``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import SNAPSHOTS, Entry, plain_journeys
from wayfold.functions.encode import Encoding
from wayfold.plans.entity import FeatureTable, entity_table
from wayfold.plans.experiment import Experiment, run_experiment
from wayfold.plans.models import ModelStore
from wayfold.plans.series import series_table
from wayfold.plans.training import Trainer, predict
from wayfold.session import cut_lineage, fresh_path
from wayfold.sources.event_tables import snapshots, table
from wayfold.sources.store import ExperimentLog

LIGHT = {
    "random_forest": {"numTrees": 5, "maxDepth": 4},
    "gbt": {"maxIter": 3, "maxDepth": 3},
    "linear": {},
}
# Of the default settings.
FOLDS, TRIALS = 5, 20
# Fits side by side; a fit of a small table leaves most cores idle.
PARALLEL = 8
ENTITY_COLUMNS = ["s_cum_wait", "s_cum_cost", "s_node_util", "s_node_avg_queue", "s_sys_util"]


def one_feature(spark, folder):
    """Ridge of the mean value on the number of arrivals; the closed form is plain SQL."""
    sn = snapshots(spark, folder)
    rows = sn.select(F.col("ts").cast("double").alias("ts"), F.col("arrivals"), F.col("avg_wait"), F.col("avg_wait").alias("label"))
    return FeatureTable(rows, ("ts",), ("arrivals",), "avg_wait", Encoding("regression"))


def ridge(spark, folder):
    trainer = Trainer(one_feature(spark, folder), ["rmse"], "temporal", 3)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {"alpha": 50.0})
    scored = predict(snapshots(spark, folder), fitted)
    return scored.select("ts", F.round("predicted", 4).alias("predicted"))


def two_valued(spark, folder, label, encoding):
    """One feature with two values, so that every learner's answer is known: what it says of each of them."""
    rows = table(spark, folder, "events").select("event_id", (F.col("event_type") == "click").cast("double").alias("clicked"), label.alias("label"))
    return FeatureTable(rows, ("event_id",), ("clicked",), "label", encoding)


def said(spark, fitted):
    return predict(spark.createDataFrame([(0.0,), (1.0,)], "clicked double"), fitted)


def logistic_rates(spark, folder):
    """Without a penalty worth its name, logistic regression gives the (class-balanced) rates of both groups."""
    trainer = Trainer(two_valued(spark, folder, (F.col("value") > 60).cast("int"), Encoding("classification", ("low", "high"))), ["accuracy"], "stratified", 2)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {"C": 1e9})
    return said(spark, fitted).select("clicked", F.round(F.col("probabilities")["high"], 3).alias("high"), "predicted")


def group_means(name, settings):
    """A tree of depth 1 on all rows, alone or as the first of a boosting, gives the means of both groups."""
    def run(spark, folder):
        trainer = Trainer(two_valued(spark, folder, F.col("value"), Encoding("regression")), ["rmse"], "shuffled", 2)
        return said(spark, trainer.fit(trainer.learners.get(name), trainer.rows, settings)).select("clicked", F.round("predicted", 4).alias("predicted"))
    return run


def class_rates(name, settings):
    """A classifying tree of depth 1 on all rows, alone or as the first of a boosting: what it says of both groups."""
    def run(spark, folder):
        trainer = Trainer(two_valued(spark, folder, (F.col("value") > 60).cast("int"), Encoding("classification", ("low", "high"))), ["accuracy"], "stratified", 2)
        fitted = trainer.fit(trainer.learners.get(name), trainer.rows, settings)
        return said(spark, fitted).select("clicked", F.round(F.col("probabilities")["high"], 4).alias("high"), "predicted")
    return run


def refitted(spark, folder):
    """Of two learners one does not exist: it is skipped, and the other is refitted on all rows."""
    trainer = Trainer(one_feature(spark, folder), ["rmse"], "temporal", 3, settings={"linear": {"alpha": 50.0}})
    outcome = trainer.run(["unknown_learner", "linear"])
    scored = predict(snapshots(spark, folder), outcome.best)
    told = [F.lit(v).alias(n) for n, v in (("learner", outcome.best.learner), ("skipped", ",".join(outcome.skipped)))]
    return scored.select("ts", F.round("predicted", 4).alias("predicted"), *told)


def ridge_by_fold(spark, folder):
    trainer = Trainer(one_feature(spark, folder), ["rmse"], "temporal", 5)
    scores = spark.createDataFrame(trainer.cross_validate("linear", {"alpha": 50.0}), "algorithm string, fold int, metric string, value double")
    return scores.select("algorithm", "fold", "metric", F.round("value", 4).alias("value"))


def saved_ridge(spark, folder):
    """The same fit as learn_ridge, saved, loaded and then applied."""
    trainer = Trainer(one_feature(spark, folder), ["rmse"], "temporal", 3)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {"alpha": 50.0})
    models = ModelStore(spark, fresh_path(spark, "models"))
    loaded = models.load(models.save("ridge", fitted, "none", {}))
    return predict(snapshots(spark, folder), loaded).select("ts", F.round("predicted", 4).alias("predicted"))


def keyless(spark, folder):
    """An experiment on a table without entity or step: it completes and its record says so."""
    rows = table(spark, folder, "orders").select(
        F.col("o_totalprice").alias("s_cum_cost"), (F.col("o_custkey") % 7).cast("double").alias("s_elapsed"), F.col("o_orderpriority").alias("status"),
    )
    log = ExperimentLog(spark, fresh_path(spark, "experiments"))
    plan = Experiment("entity_classification", "keyless", "status", ("linear",), ("accuracy",), 2, columns=("s_cum_cost", "s_elapsed"), settings={"linear": {"maxIter": 5}})
    result = run_experiment(rows, plan, log)
    return log.experiments().select("name", "status", F.col("report").isNotNull().alias("reported"), F.lit(len(result.outcome.best.classes) if result.outcome else 0).alias("classes"))


def hourly(spark, folder):
    return series_table(snapshots(spark, folder), lags=("1h", "2h"), rolling=("2h",), columns=["arrivals", "in_queue", "busy"])


def delayed(spark, folder):
    return entity_table(plain_journeys(spark, folder), "delay_severity", "entry_only", columns=ENTITY_COLUMNS)


def breached(spark, folder):
    return entity_table(plain_journeys(spark, folder), "sla_breach", "entry_only", columns=ENTITY_COLUMNS)


def cross_validated(name, make, metrics, strategy, folds=2, settings=LIGHT):
    def run(spark, folder):
        trainer = Trainer(make(spark, folder), metrics, strategy, folds, settings=settings, parallel=PARALLEL)
        scores = spark.createDataFrame(trainer.cross_validate(name), "algorithm string, fold int, metric string, value double")
        return scores
    return run


def ranked(spark, folder):
    """Rank, refit and importances of three learners on the hourly series."""
    trainer = Trainer(hourly(spark, folder), ["rmse", "mae"], "temporal", 2, settings=LIGHT)
    outcome = trainer.run(["linear", "random_forest", "unknown_learner"])
    best = outcome.ranking.select("algorithm", "rank", F.col("mean").alias("value"), F.lit("cv_rmse").alias("kind"))
    weights = outcome.importance.select(F.col("feature").alias("algorithm"), "rank", F.col("importance").alias("value"), F.lit("importance").alias("kind"))
    return best.unionByName(weights)


def searched(spark, folder):
    trainer = Trainer(hourly(spark, folder), ["rmse"], "temporal", 2, settings={})
    found = trainer.search("linear", 3)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "setting string, value double")


def searched_fully(spark, folder):
    """The default search over forest and boosting."""
    trainer = Trainer(hourly(spark, folder), ["rmse"], "temporal", FOLDS)
    found = [(name, k, str(v)) for name in ("random_forest", "gbt") for k, v in trainer.search(name, TRIALS).items()]
    return spark.createDataFrame(found, "algorithm string, setting string, value string")


def experiment(spark, folder):
    """A whole entity experiment, recorded; the log row and the saved model's predictions come back."""
    path = fresh_path(spark, "experiments")
    log, models = ExperimentLog(spark, path), ModelStore(spark, path)
    # Written once, because checks, features and labels each read it.
    tr = cut_lineage(plain_journeys(spark, folder), "journeys")
    plan = Experiment(
        "entity_classification", "checked run", "wait_ratio_class", ("linear",), ("f1_weighted", "accuracy"), 2,
        point="entry_only", columns=tuple(ENTITY_COLUMNS), settings=LIGHT,
    )
    result = run_experiment(tr, plan, log, models)
    if result.status != "completed":
        raise RuntimeError(result.error)
    scored = predict(tr, models.load(result.model_id))
    return scored.groupBy("predicted").agg(F.count(F.lit(1)).alias("rows"))


MEANS = """SELECT CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END AS clicked, round(avg(value), 4) AS predicted FROM events GROUP BY 1"""
RATES = """WITH g AS (SELECT CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END AS clicked, count(*) FILTER (value > 60) AS a, count(*) FILTER (NOT value > 60) AS b FROM events GROUP BY 1),
        p AS (SELECT clicked, (a / sum(a) OVER ()) / (a / sum(a) OVER () + b / sum(b) OVER ()) AS high FROM g)"""
RIDGE = f"""WITH {SNAPSHOTS},
        mo AS (SELECT avg(arrivals) AS mx, avg(avg_wait) AS my, covar_pop(arrivals, avg_wait) * count(*) AS sxy,
               var_pop(arrivals) * count(*) AS sxx FROM sn)
        SELECT ts, round(my + sxy / (sxx + 50e0) * (arrivals - mx), 4) AS predicted FROM sn, mo"""

# Default settings, 5 folds; long runs.
FULL = [
    Entry("learn_full_forest_series", cross_validated("random_forest", hourly, ["rmse"], "temporal", FOLDS, {})),
    Entry("learn_full_forest_entity", cross_validated("random_forest", delayed, ["f1_weighted"], "stratified", FOLDS, {})),
    Entry("learn_full_boosting_series", cross_validated("gbt", hourly, ["rmse"], "temporal", FOLDS, {})),
    Entry("learn_full_boosting_binary", cross_validated("gbt", breached, ["auc_roc"], "stratified", FOLDS, {})),
    Entry("learn_full_search", searched_fully),
]

ENTRIES = [
    Entry("learn_ridge", ridge, RIDGE),
    Entry("learn_saved_ridge", saved_ridge, RIDGE),
    Entry("learn_logistic_rates", logistic_rates, """
        WITH g AS (SELECT CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END AS clicked, count(*) FILTER (value > 60) AS a, count(*) FILTER (NOT value > 60) AS b FROM events GROUP BY 1),
        p AS (SELECT clicked, (a / sum(a) OVER ()) / (a / sum(a) OVER () + b / sum(b) OVER ()) AS high FROM g)
        SELECT clicked, round(high, 3) AS high, CASE WHEN high > 0.5 THEN 'high' ELSE 'low' END AS predicted FROM p"""),
    Entry("learn_forest_stump", group_means("random_forest", {"numTrees": 1, "maxDepth": 1, "bootstrap": False}), MEANS),
    Entry("learn_boosting_stump", group_means("gbt", {"maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0}), MEANS),
    Entry("learn_forest_class_stump", class_rates("random_forest", {"numTrees": 1, "maxDepth": 1, "bootstrap": False}), RATES + """
        SELECT clicked, round(high, 4) AS high, CASE WHEN high > 0.5 THEN 'high' ELSE 'low' END AS predicted FROM p"""),
    # The first tree fits labels of -1 and 1, and the probability is the logistic function of twice its value.
    Entry("learn_boosting_class_stump", class_rates("gbt", {"maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0}), RATES + """
        SELECT clicked, round(1 / (1 + exp(-2 * (2 * high - 1))), 4) AS high, CASE WHEN high > 0.5 THEN 'high' ELSE 'low' END AS predicted FROM p"""),
    Entry("learn_refit_best", refitted, f"SELECT *, 'linear' AS learner, 'unknown_learner' AS skipped FROM ({RIDGE})"),
    Entry("learn_ridge_by_fold", ridge_by_fold, f"""WITH {SNAPSHOTS},
        nu AS (SELECT arrivals AS x, avg_wait AS y, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS n FROM sn),
        fo AS (SELECT f AS fold, n - 5 * (n // 6) + f * (n // 6) AS lo, n - 5 * (n // 6) + (f + 1) * (n // 6) AS hi FROM (SELECT DISTINCT n FROM nu), range(5) r(f)),
        mo AS (SELECT fold, lo, hi, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
          FROM fo JOIN nu ON place < lo GROUP BY fold, lo, hi)
        SELECT 'linear' AS algorithm, CAST(fold AS INTEGER) AS fold, 'rmse' AS metric,
          round(sqrt(avg((y - (my + sxy / (sxx + 50e0) * (x - mx))) ** 2)), 4) AS value
        FROM mo JOIN nu ON place >= lo AND place < hi GROUP BY fold"""),
    Entry("learn_keyless", keyless, """
        SELECT 'keyless' AS name, 'completed' AS status, true AS reported, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS classes FROM orders"""),
    Entry("learn_linear_series", cross_validated("linear", hourly, ["rmse", "mae", "mape", "r2"], "temporal", 5)),
    Entry("learn_forest_series", cross_validated("random_forest", hourly, ["rmse"], "temporal")),
    Entry("learn_boosting_series", cross_validated("gbt", hourly, ["rmse"], "temporal")),
    Entry("learn_logistic_entity", cross_validated("linear", delayed, ["f1_weighted", "auc_roc", "precision", "recall"], "stratified", 5)),
    Entry("learn_forest_entity", cross_validated("random_forest", delayed, ["f1_weighted"], "stratified")),
    Entry("learn_boosting_binary", cross_validated("gbt", breached, ["auc_roc"], "stratified")),
    Entry("learn_boosting_classes", cross_validated("gbt", delayed, ["f1_weighted"], "shuffled")),
    Entry("learn_ranking", ranked),
    Entry("learn_search", searched),
    Entry("learn_experiment", experiment),
    *FULL,
]
