"""One experiment from table to stored result."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from wayfold.functions.durations import steps
from wayfold.model import DERIVED_LABELS, ENTITY_DEFAULTS, SERIES_DEFAULTS
from wayfold.operators.discovery import problem_type
from wayfold.operators.gate import Plan, class_findings, gate, warnings
from wayfold.operators.series import bucket_interval
from wayfold.plans.entity import FeatureTable, entity_table
from wayfold.plans.learners import Learners, default_learners
from wayfold.plans.models import ModelStore
from wayfold.plans.report import report_document, report_tables
from wayfold.plans.series import series_table
from wayfold.plans.training import Outcome, Trainer
from wayfold.sources.store import DatasetStore, ExperimentLog


@dataclass
class Experiment:
    """Settings of a run; what is left out takes the defaults of the problem type."""

    kind: str = "time_series"
    name: str = ""
    target: str | None = None
    algorithms: tuple[str, ...] | None = None
    metrics: tuple[str, ...] | None = None
    folds: int | None = None
    strategy: str | None = None
    seed: int | None = None
    balance: bool | None = None
    trials: int = 0
    point: str = "all_steps"
    lookback: str = SERIES_DEFAULTS["lookback"]
    horizon: str = SERIES_DEFAULTS["horizon"]
    lags: tuple[str, ...] = SERIES_DEFAULTS["lags"]
    rolling: tuple[str, ...] = SERIES_DEFAULTS["rolling"]
    columns: tuple[str, ...] = ()
    gap_to_test: bool = False
    group: str | None = None
    exclude: tuple[str, ...] = ()
    with_trend: bool = True
    with_ratios: bool = True
    with_cross_node: bool = True
    skip_ratios: tuple[str, ...] = ()
    entity_state: bool = True
    node_state: bool = True
    system_state: bool = True
    label_options: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def resolved(self) -> "Experiment":
        base = SERIES_DEFAULTS if self.kind == "time_series" else ENTITY_DEFAULTS
        filled = {k: base[k] for k in ("target", "algorithms", "metrics", "folds", "seed", "balance") if getattr(self, k) is None}
        strategy = self.strategy or ("temporal" if self.kind == "time_series" else "stratified")
        return Experiment(**{**asdict(self), **filled, "strategy": strategy})

    def plan(self, learners: Learners | None = None) -> Plan:
        return Plan(
            self.target, self.kind, tuple(self.columns), self.lookback, self.horizon, tuple(self.lags), self.point,
            self.folds, self.strategy, tuple(self.algorithms), tuple(self.metrics), self.seed,
            tuple((learners or default_learners()).names()),
        )


@dataclass
class Result:
    experiment_id: str
    status: str
    seconds: float
    error: str | None = None
    findings: DataFrame | None = None
    warnings: list = field(default_factory=list)
    table: FeatureTable | None = None
    outcome: Outcome | None = None
    model_id: str | None = None


def build_features(df: DataFrame, run: Experiment) -> FeatureTable:
    columns = list(run.columns) or None
    if run.kind == "time_series":
        return series_table(
            df, run.target, run.lookback, run.horizon, run.lags, run.rolling, run.with_trend, run.with_ratios, run.with_cross_node,
            columns=columns, exclude=list(run.exclude),
        )
    return entity_table(
        df, run.target, run.point, label_options=run.label_options, skip_ratios=tuple(run.skip_ratios), columns=columns, exclude=list(run.exclude),
        entity_state=run.entity_state, node_state=run.node_state, system_state=run.system_state,
    )


def run_experiment(
    df: DataFrame, experiment: Experiment, log: ExperimentLog | None = None, models: ModelStore | None = None, learners: Learners | None = None,
) -> Result:
    """Check, build features, cross-validate, refit and record; a failure, of the report too, becomes a failed result and record."""
    run = experiment.resolved()
    experiment_id, started = uuid.uuid4().hex[:12], time.monotonic()
    if log:
        log.create(experiment_id, run.name or experiment_id, {**asdict(run), "problem_type": run.kind})
    try:
        result = _run(df, run, experiment_id, started, models, learners)
        if log:
            _record(log, run, result)
    except Exception as error:
        result = Result(experiment_id, "failed", time.monotonic() - started, str(error))
        if log:
            log.save_result(experiment_id, "failed", result={"error": result.error})
    return result


def run_stored(
    store: DatasetStore, dataset_id: str, experiment: Experiment, layer: str | None = None, log: ExperimentLog | None = None,
    models: ModelStore | None = None, learners: Learners | None = None, kind: str | None = None,
) -> Result:
    """A run on a registered dataset; the layer and the kind of problem follow from each other and from what the dataset has."""
    present = store.layers(dataset_id)
    chosen = problem_type(kind, layer, "snapshots" in present, "trajectories" in present)
    df = store.read(dataset_id, layer or ("snapshots" if chosen == "time_series" else "trajectories"))
    return run_experiment(df, Experiment(**{**asdict(experiment), "kind": chosen}), log, models, learners)


def _run(
    df: DataFrame, run: Experiment, experiment_id: str, started: float, models: ModelStore | None, learners: Learners | None
) -> Result:
    plan = run.plan(learners)
    found = gate(df, plan)
    broken = found.collect()
    if not broken:
        table = build_features(df, run)
        if run.kind != "time_series" and run.target in DERIVED_LABELS:
            found = class_findings(table.rows, run.target)
            broken = found.collect()
    if broken:
        text = "; ".join(f"[{r['code']}] {r['message']}" for r in broken)
        return Result(experiment_id, "failed", time.monotonic() - started, text, found, warnings(plan))
    gap = 0
    if run.gap_to_test and run.kind == "time_series":
        gap = steps(run.horizon, bucket_interval(df).seconds)
    trainer = Trainer(
        table, list(run.metrics), run.strategy, run.folds, run.seed, run.balance, gap, run.group, learners, run.settings
    )
    outcome = trainer.run(list(run.algorithms), run.trials)
    model_id = None
    if models:
        model_id = models.save(f"{experiment_id}-{outcome.best.learner}", outcome.best, experiment_id, outcome.train_metrics)
    return Result(
        experiment_id, "completed", time.monotonic() - started, None, found, warnings(plan), table, outcome, model_id
    )


def _record(log: ExperimentLog, run: Experiment, result: Result) -> None:
    if result.outcome is None:
        log.save_result(result.experiment_id, result.status, result={"error": result.error})
        return
    facts = {
        "experiment_id": result.experiment_id, "target": run.target, "best": result.outcome.best.learner,
        "features": len(result.table.features), "train_metrics": result.outcome.train_metrics,
    }
    report = report_document(facts, report_tables(result.outcome, list(result.table.keys)))
    metrics = {k: v for k, v in result.outcome.train_metrics.items() if v is not None}
    summary = {**facts, "model_id": result.model_id, "seconds": result.seconds}
    log.save_result(result.experiment_id, result.status, metrics, summary, {"document": report})
