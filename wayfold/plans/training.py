"""Cross-validation, selection, refit and scoring of learners on a feature table."""

from __future__ import annotations

import functools
import logging
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.hashing import named_seed
from wayfold.operators.compare import fold_summary, rank_algorithms, top_importance
from wayfold.operators.folds import (
    balanced_class_weights,
    shuffled_folds,
    temporal_bounds,
    temporal_folds,
    temporal_split,
    weigh,
)
from wayfold.operators.metrics import LOWER_IS_BETTER, evaluate
from wayfold.plans.entity import FeatureTable
from wayfold.plans.learners import CLASSIFICATION, Facts, Learner, Learners, default_learners, sample_settings
from wayfold.plans.trees import fit_in_a_task, fits_a_task, plan_of, predict_in_a_task
from wayfold.session import cut_lineage, shared_folder

log = logging.getLogger(__name__)

STRATEGIES = ("temporal", "stratified", "shuffled")
# Each round of an iterative fit runs a task per partition, so small tables are read by few tasks. Larger ones stay as they are.
ROWS_PER_TASK = 20_000
# A setting of iterative learners: the share of rows that tells when more rounds no longer help.
EARLY_STOP = "early_stop"


@dataclass
class FittedModel:
    """A fitted model and what is needed to apply it to named columns."""

    model: Model
    learner: str
    task: str
    features: tuple[str, ...]
    classes: tuple[str, ...] | None = None
    settings: dict = field(default_factory=dict)


@dataclass
class Outcome:
    """Everything a training run yields; tables are DataFrames, ``best`` is fitted on all rows."""

    best: FittedModel
    scores: DataFrame
    summary: DataFrame
    ranking: DataFrame
    importance: DataFrame
    train_metrics: dict[str, float | None]
    predictions: DataFrame
    out_of_fold: DataFrame
    skipped: dict[str, str]


def assembled(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Adds the ``features`` vector; a missing column or null counts as 0."""
    return df.withColumn("features", array_to_vector(F.array(*filled(df, features))))


def filled(df: DataFrame, features: tuple[str, ...]) -> list[Column]:
    """Features as numbers; a missing column or null counts as 0."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features]


def score(df: DataFrame, fitted: FittedModel) -> DataFrame:
    """Adds ``y_pred`` and, for a classification, ``proba`` (one number per class). Batch and streams share it."""
    scored = fitted.model.transform(assembled(df, fitted.features))
    kept = [c for c in df.columns]
    if fitted.task != CLASSIFICATION:
        return scored.select(*kept, F.col("prediction").alias("y_pred"))
    return scored.select(*kept, F.col("prediction").cast("int").alias("y_pred"), probabilities(scored).alias("proba"))


def probabilities(scored: DataFrame) -> Column:
    """Class probabilities; where a model only gives margins, their soft maximum."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    exps = F.transform(vector_to_array("rawPrediction"), lambda v: F.exp(v))
    total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
    return F.transform(exps, lambda v: v / total)


def predict(df: DataFrame, fitted: FittedModel) -> DataFrame:
    """Scoring by feature name with class names: adds ``predicted`` and ``probabilities`` (MAP by class)."""
    scored = score(df, fitted)
    if fitted.classes is None:
        return scored.withColumnRenamed("y_pred", "predicted")
    names = F.array(*[F.lit(c) for c in fitted.classes])
    # A model that never saw the last classes gives fewer numbers.
    shares = [F.struct(F.lit(c), F.coalesce(F.get("proba", i), F.lit(0.0))) for i, c in enumerate(fitted.classes)]
    return scored.select(
        *df.columns,
        F.element_at(names, F.col("y_pred") + 1).alias("predicted"),
        F.map_from_entries(F.array(*shares)).alias("probabilities"),
    )


def with_folds(table: FeatureTable, rows: DataFrame, strategy: str, folds: int, seed: int, group: str | None) -> tuple[DataFrame, list | None]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown fold strategy {strategy!r}; known: {list(STRATEGIES)}")
    if strategy == "temporal":
        order = [c for c in table.keys if c == "ts"] or list(table.keys)
        return temporal_folds(rows, folds, order), temporal_bounds(rows.count(), folds)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in table.keys])
    strata = "label" if strategy == "stratified" else None
    return shuffled_folds(rows, folds, key, seed, strata, group, rows=table.encoding.rows), None


def split(rows: DataFrame, fold: int, bounds: list | None, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    if bounds is not None:
        return temporal_split(rows, fold, bounds, gap)
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)


class Trainer:
    """Fits learners on a feature table that is written once and read for every fit."""

    def __init__(
        self,
        table: FeatureTable,
        metrics: list[str],
        strategy: str,
        folds: int,
        seed: int = 42,
        balance: bool = False,
        gap: int = 0,
        group: str | None = None,
        learners: Learners | None = None,
        settings: dict[str, dict] | None = None,
        parallel: int = 4,
    ) -> None:
        self.table, self.metrics, self.folds, self.seed = table, list(metrics), folds, seed
        self.balance, self.gap, self.parallel = balance, gap, parallel
        self.learners = learners or default_learners()
        self.settings = settings or {}
        self.task = table.encoding.task
        self.classes = len(table.encoding.classes or ())
        slim = table.rows.select(*table.keys, *table.features, F.col("label").cast("double").alias("label"))
        if strategy == "temporal":
            slim = cut_lineage(slim, "features")  # numbering the rows reads them several times
        folded, self.bounds = with_folds(table, slim, strategy, folds, seed, group)
        self.rows = cut_lineage(folded, "folds")
        context = self.rows.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            # Boosting cuts its lineage there every few rounds; without a folder hundreds of rounds would carry all earlier ones.
            context.setCheckpointDir(shared_folder(self.rows.sparkSession))
        # Written predictions of each learner's folds by the model that has not seen them.
        self._held_out: dict[tuple[str, int], DataFrame] = {}
        self._groups: list[Row] | None = None

    def _fold_groups(self) -> list[Row]:
        """Rows, label sum and sum of squares per fold and class (one class for a regression), from one job."""
        if self._groups is None:
            label = F.col("label") if self.task == CLASSIFICATION else F.lit(0.0)
            y = F.col("label")
            self._groups = (
                self.rows.groupBy("fold", label.alias("class"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
                .collect()
            )
        return self._groups

    def _facts(self, fold: int | None) -> tuple[Facts, dict[float, int]]:
        """What a fit on everything but ``fold`` (on all rows for None) must know: size, spread, class counts.

        The few rows a temporal gap leaves out are still counted; they only scale a penalty.
        """
        if self.bounds is not None and fold is not None:
            kept = [g for g in self._fold_groups() if g["fold"] < fold]
        else:
            kept = [g for g in self._fold_groups() if g["fold"] != fold]
        rows = sum(g["n"] for g in kept)
        mean = sum(g["s"] for g in kept) / rows if rows else 0.0
        variance = sum(g["q"] for g in kept) / rows - mean * mean if rows else 0.0
        counts: dict[float, int] = {}
        for g in kept:
            counts[g["class"]] = counts.get(g["class"], 0) + g["n"]
        return Facts(rows, math.sqrt(max(variance, 0.0)) or 1.0, self.classes), counts

    def _prepared(self, learner: Learner, train: DataFrame, settings: dict, fold: int | None) -> tuple:
        """Weighted rows, the estimator, how one task grows its trees (None if ``pyspark.ml`` does), partitions, and the column of rows that stop it early."""
        facts, counts = self._facts(fold)
        if self.task == CLASSIFICATION:
            balanced = self.balance or learner.always_balanced
            train = weigh(train, "label", balanced_class_weights(counts) if balanced else {})
        held = None if settings.get(EARLY_STOP) is None else "held_for_stop"
        estimator = learner.build(self.task, facts, named_seed(learner.name, self.seed), {k: v for k, v in settings.items() if k != EARLY_STOP}, held)
        plan = plan_of(estimator)
        if plan and not fits_a_task(plan, facts.rows, len(self.table.features)):
            plan = None
        return train, estimator, plan, max(1, math.ceil(facts.rows / ROWS_PER_TASK)), held

    def fit(self, learner: Learner, train: DataFrame, settings: dict, fold: int | None = None) -> FittedModel:
        """One fit; classes are weighted when asked or when the learner always does so."""
        train, estimator, plan, few, held = self._prepared(learner, train, settings, fold)
        if plan:
            return self._fitted(fit_in_a_task(estimator, plan, train, filled(train, self.table.features), few), learner, settings)
        columns = ["features", "label", *[c for c in ("weight",) if c in train.columns]]
        ready = assembled(train, self.table.features)
        if held:
            key = F.xxhash64(F.lit(self.seed), *[F.col(k).cast("string") for k in self.table.keys])
            ready, columns = ready.withColumn(held, F.pmod(key, F.lit(10_000)) < F.lit(settings[EARLY_STOP] * 10_000)), [*columns, held]
        return self._fitted(estimator.fit(ready.select(*columns).coalesce(few)), learner, settings)

    def _fitted(self, model: Model, learner: Learner, settings: dict) -> FittedModel:
        names = self.table.encoding.names
        return FittedModel(model, learner.name, self.task, self.table.features, tuple(names) if names else None, settings)

    def _predictions(self, rows: DataFrame, fitted: FittedModel) -> DataFrame:
        scored = score(rows, fitted)
        extra = ["proba"] if self.task == CLASSIFICATION else []
        y = F.col("label").cast("int") if self.task == CLASSIFICATION else F.col("label")
        return scored.select(*self.table.keys, y.alias("y"), "y_pred", *extra)

    def measure(self, predictions: DataFrame, written: bool = False) -> dict[str, float | None]:
        if self.task != CLASSIFICATION:
            return evaluate(predictions, self.metrics, self.task)
        if written:
            return evaluate(predictions, self.metrics, self.task, self.classes, "proba")
        # Counting and ranking measures each read the predictions; they are dropped again right after.
        kept = predictions.drop(*self.table.keys).persist()
        try:
            return evaluate(kept, self.metrics, self.task, self.classes, "proba")
        finally:
            kept.unpersist()

    def _one_fold(self, learner: Learner, settings: dict, fold: int, keep: bool) -> tuple[DataFrame, dict[str, float | None]]:
        """Predictions for the rows of a fold, written if they are to be kept, and their metrics."""
        train, test = split(self.rows, fold, self.bounds, self.gap)
        if not keep and self.task != CLASSIFICATION:
            ready, estimator, plan, few, _ = self._prepared(learner, train, settings, fold)
            if plan:
                # Nobody asks for the model: the task that grows the trees also says what they make of the fold.
                predictions = predict_in_a_task(estimator, plan, ready, test, filled(ready, self.table.features), few)
                return predictions, self.measure(predictions)
        predictions = self._predictions(test, self.fit(learner, train, settings, fold))
        if keep:
            predictions = cut_lineage(predictions.withColumn("fold", F.lit(fold)), "held_out")
        return predictions, self.measure(predictions, written=keep)

    def _side_by_side(self, jobs: list[tuple[int, Callable[[], object]]]) -> list[object]:
        """Results of jobs, ``parallel`` at a time; each is (group, what to do).

        A group is a Spark job group with a scheduler pool of its own, so that a fair scheduler shares the cluster between groups. When one
        of its jobs fails, what else runs for the group is cancelled and what waits is not begun; their results are that exception.
        """
        context = self.rows.sparkSession.sparkContext
        batch, failed = uuid.uuid4().hex, {}

        def work(job: tuple[int, Callable[[], object]]) -> object:
            group, run = job
            if group in failed:
                return failed[group]
            context.setJobGroup(f"{batch}-{group}", f"fits of group {group}", True)
            context.setLocalProperty("spark.scheduler.pool", f"fits-{group}")
            try:
                return run()
            except Exception as error:
                failed.setdefault(group, error)
                context.cancelJobGroup(f"{batch}-{group}")
                return failed[group]

        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(inheritable_thread_target(self.rows.sparkSession)(work), jobs))

    def cross_validate(self, name: str, settings: dict | None = None) -> list[tuple[str, int, str, float | None]]:
        """(algorithm, fold, metric, value) of one learner; folds run side by side."""
        learner = self._able(name)
        chosen = self.settings.get(name, {}) if settings is None else settings
        folds = range(self.folds)
        results = self._side_by_side([(0, lambda fold=fold: self._one_fold(learner, chosen, fold, True)) for fold in folds])
        rows = []
        for fold, result in zip(folds, results):
            if isinstance(result, Exception):
                raise result
            self._held_out[name, fold], values = result
            rows += [(name, fold, m, v) for m, v in values.items()]
        return rows

    def _able(self, name: str) -> Learner:
        learner = self.learners.get(name)
        if self.task not in learner.tasks:
            raise ValueError(f"learner {name!r} does not support {self.task}")
        return learner

    def trials(self, name: str, trials: int) -> list[tuple[dict, float | None]]:
        """(settings, mean of the first metric) of seeded random draws; the fits of all trials and folds are one queue.

        A trial with a failing fold has no value; its other folds are cancelled.
        """
        learner, fixed = self._able(name), self.settings.get(name, {})
        drawn = [{**s, **fixed} for s in sample_settings(learner.space(self.task), trials, named_seed(f"search:{name}", self.seed))]
        jobs = [
            (trial, lambda settings=settings, fold=fold: self._one_fold(learner, settings, fold, False)[1].get(self.metrics[0]))
            for trial, settings in enumerate(drawn) for fold in range(self.folds)
        ]
        results = self._side_by_side(jobs)
        out = []
        for trial, settings in enumerate(drawn):
            own = results[trial * self.folds : (trial + 1) * self.folds]
            errors = [r for r in own if isinstance(r, Exception)]
            if errors:
                log.warning("trial %s of learner %s failed: %s", trial, name, errors[0])
            values = [] if errors else [v for v in own if v is not None]
            out.append((settings, sum(values) / len(values) if values else None))
        if jobs and all(isinstance(r, Exception) for r in results):
            raise results[0]
        return out

    def search(self, name: str, trials: int) -> dict:
        """Settings with the best mean of the first metric among seeded random draws; of equal ones, the first drawn."""
        lower = self.metrics[0] in LOWER_IS_BETTER
        best, best_value = self.settings.get(name, {}), None
        for settings, mean in self.trials(name, trials):
            if mean is not None and (best_value is None or (mean < best_value if lower else mean > best_value)):
                best, best_value = settings, mean
        return best

    def run(self, names: list[str], trials: int = 0) -> Outcome:
        """Cross-validate every learner, rank by the first metric, refit the best on all rows."""
        scores, skipped, chosen = [], {}, {}
        for name in names:
            try:
                chosen[name] = self.search(name, trials) if trials else self.settings.get(name, {})
                scores += self.cross_validate(name, chosen[name])
            except Exception as error:  # one failing learner must not end the run
                log.warning("skipping learner %s: %s", name, error)
                skipped[name] = str(error)
        if not scores:
            raise RuntimeError(f"every learner failed: {skipped}")
        spark = self.rows.sparkSession
        # One row per learner, fold and metric: in one partition, ranking them needs no exchange.
        score_rows = spark.createDataFrame(scores, "algorithm string, fold int, metric string, value double").coalesce(1)
        summary = fold_summary(score_rows)
        ranking = rank_algorithms(summary, self.metrics[0])
        winner = ranking.where("rank = 1").first()["algorithm"]
        learner = self.learners.get(winner)
        best = self.fit(learner, self.rows, chosen[winner])
        predictions = cut_lineage(self._predictions(self.rows, best), "in_sample")
        has_proba = "proba" if "proba" in predictions.columns else None
        return Outcome(
            best, score_rows, summary, ranking, importance(spark, best),
            evaluate(predictions, self.metrics, self.task, self.classes, has_proba),
            predictions, self.out_of_fold(winner), skipped,
        )

    def out_of_fold(self, name: str) -> DataFrame:
        """Predictions for each tested row by the cross-validated model that has not seen it, with its ``fold``; scored and written once."""
        parts = [self._held_out[name, fold] for fold in range(self.folds)]
        return functools.reduce(DataFrame.unionByName, parts)


def raw_importance(fitted: FittedModel) -> list[tuple[str, float]]:
    """One number per feature: tree importances, or absolute coefficients (mean over classes)."""
    model = fitted.model
    parts = model.models if isinstance(model, OneVsRestModel) else [model]
    totals = [0.0] * len(fitted.features)
    for part in parts:
        if hasattr(part, "featureImportances"):
            values = part.featureImportances.toArray()
        elif hasattr(part, "coefficientMatrix"):
            values = abs(part.coefficientMatrix.toArray()).mean(axis=0)
        else:
            values = abs(part.coefficients.toArray())
        totals = [t + float(v) / len(parts) for t, v in zip(totals, values)]
    return list(zip(fitted.features, totals))


def importance(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    raw = spark.createDataFrame(raw_importance(fitted), "feature string, raw double").coalesce(1)
    return top_importance(raw, len(fitted.features))


def pipeline(fitted: FittedModel) -> PipelineModel:
    """The model with its assembling step, ready to be saved or served by plain ``transform``."""
    assembler = VectorAssembler(inputCols=list(fitted.features), outputCol="features", handleInvalid="keep")
    return PipelineModel([assembler, fitted.model])
