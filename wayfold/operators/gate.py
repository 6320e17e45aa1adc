"""Checks before training: every rule is evaluated, every violation becomes a row.

Rows are (code, field, message, suggestion). Rules that read data share one
aggregation; class sizes take one grouped count.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.durations import seconds
from wayfold.functions.time import epoch_seconds
from wayfold.model import DERIVED_LABELS, MAX_CLASSES, SERIES_DEFAULTS, is_numeric, is_text
from wayfold.operators.observation import POINTS

# Limits of the rules, known names, and targets that only ever grow.
LEAST_ROWS = {"time_series": 50, "entity_classification": 100}
MOST_NULL_TARGETS = 0.10
LEAST_WINDOWS = 50
LEAST_CLASS_ROWS = 10
LEAST_FOLDS = 2
KNOWN_ALGORITHMS = ("gbt", "random_forest", "linear")
KNOWN_METRICS = (
    "rmse", "mae", "mape", "r2", "f1_weighted", "f1_macro", "auc_roc", "precision", "recall", "accuracy",
)
GROWING_TARGETS = ("cumulative_throughput", "cumulative_arrivals", "total_processed")

FINDING = "code string, field string, message string, suggestion string"


@dataclass(frozen=True)
class Plan:
    """What is about to be trained, as far as the checks need to know."""

    target: str
    kind: str = "time_series"
    features: tuple[str, ...] = ()
    lookback: str = SERIES_DEFAULTS["lookback"]
    horizon: str = SERIES_DEFAULTS["horizon"]
    lags: tuple[str, ...] = SERIES_DEFAULTS["lags"]
    point: str = "all_steps"
    folds: int = 5
    strategy: str = "temporal"
    algorithms: tuple[str, ...] = ("gbt",)
    metrics: tuple[str, ...] = ("rmse",)
    seed: int = 42
    known_algorithms: tuple[str, ...] = field(default=KNOWN_ALGORITHMS)

    @property
    def derived(self) -> bool:
        return self.target in DERIVED_LABELS


def argument_findings(plan: Plan) -> list[tuple[str, str, str, str | None]]:
    """Violations that need no data."""
    found: list[tuple[str, str, str, str | None]] = []

    def add(code: str, where: str, message: str, suggestion: str | None = None) -> None:
        found.append((code, where, message, suggestion))

    if plan.target in plan.features:
        add("V-04", "features.feature_columns", f"target {plan.target} is among the features", "remove it")
    if plan.seed < 0:
        add("V-07", "seed", f"seed {plan.seed} is negative", "use zero or more")
    unknown = [a for a in plan.algorithms if a not in plan.known_algorithms]
    if unknown:
        add("V-08", "model.algorithms", f"unknown algorithms: {', '.join(unknown)}", ", ".join(plan.known_algorithms))
    if plan.folds < LEAST_FOLDS:
        add("V-09", "model.cross_validation.folds", f"{plan.folds} folds, at least {LEAST_FOLDS} needed")
    unknown = [m for m in plan.metrics if m not in KNOWN_METRICS]
    if unknown:
        add("V-10", "evaluation.metrics", f"unknown metrics: {', '.join(unknown)}", ", ".join(KNOWN_METRICS))
    if plan.kind == "time_series":
        long = [d for d in plan.lags if seconds(d) > seconds(plan.lookback)]
        if long:
            add("VT-05", "features.lag_intervals", f"lags beyond the lookback {plan.lookback}: {', '.join(long)}")
        if plan.strategy != "temporal":
            add("VT-06", "model.cross_validation.strategy", f"{plan.strategy} folds on a time series", "use temporal")
    elif plan.point not in POINTS:
        add("VE-04", "features.observation_point", f"unknown observation point {plan.point}", ", ".join(POINTS))
    return found


def schema_findings(df: DataFrame, plan: Plan) -> list[tuple[str, str, str, str | None]]:
    """Violations that only need the schema."""
    found: list[tuple[str, str, str, str | None]] = []
    types = {f.name: f.dataType for f in df.schema.fields}
    if not plan.derived and plan.target not in types:
        found.append(("V-03", "features.target", f"target {plan.target} not found", ", ".join(df.columns)))
    missing = [c for c in plan.features if c not in types]
    if missing:
        found.append(("V-05", "features.feature_columns", f"features not found: {', '.join(missing)}", None))
    wordy = [c for c in plan.features if c in types and not is_numeric(types[c])]
    if wordy:
        found.append(("V-06", "features.feature_columns", f"features not numeric: {', '.join(wordy)}", None))
    if plan.kind == "time_series":
        if "ts" not in types:
            found.append(("VT-01", "dataset", "no ts column", "name the time column ts"))
        if plan.target in types and not is_numeric(types[plan.target]):
            found.append(("VT-04", "features.target", f"target {plan.target} is not numeric", None))
    return found


def gate(df: DataFrame, plan: Plan) -> DataFrame:
    """All violations of ``plan`` on ``df``; an empty result means that training may start."""
    spark = df.sparkSession
    fixed = argument_findings(plan) + schema_findings(df, plan)
    found = spark.createDataFrame(fixed, FINDING)
    found = found.unionByName(_data_findings(df, plan))
    if plan.kind != "time_series" and not plan.derived and plan.target in df.columns:
        found = found.unionByName(class_findings(df, plan.target))
    return found


def warnings(plan: Plan) -> list[tuple[str, str, str, str | None]]:
    if plan.target not in GROWING_TARGETS:
        return []
    return [("W-01", "features.target", f"target {plan.target} only ever grows", "predict a rate instead")]


def _row(code: str, where: str, message: Column, suggestion: str | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(where).alias("field"), message.alias("message"),
        F.lit(suggestion).cast("string").alias("suggestion"),
    )


def _text(*parts: Any) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _data_findings(df: DataFrame, plan: Plan) -> DataFrame:
    known = set(df.columns)
    has_target = not plan.derived and plan.target in known
    timed = plan.kind == "time_series" and "ts" in known
    measures = [F.count(F.lit(1)).alias("n")]
    if has_target:
        measures.append(F.count_if(F.col(plan.target).isNull()).alias("nulls"))
    if timed:
        ts = epoch_seconds(df, "ts")
        measures.append((F.max(ts) - F.min(ts)).alias("span"))
    facts = df.agg(*measures)

    least = LEAST_ROWS[plan.kind]
    rules = [F.when(F.col("n") < least, _row("V-02", "dataset", _text(F.col("n").cast("string"), f" rows, at least {least} needed")))]
    if has_target:
        share = F.coalesce(F.try_divide("nulls", "n"), F.lit(0.0))
        rules.append(
            F.when(
                share > MOST_NULL_TARGETS,
                _row("V-11", "features.target", _text(F.col("nulls").cast("string"), f" of the values of {plan.target} are null")),
            )
        )
    if timed:
        back, ahead = seconds(plan.lookback), seconds(plan.horizon)
        usable = F.col("span") - back - ahead
        windows = F.try_divide(usable, F.try_divide("span", F.col("n") - 1))
        rules.append(
            F.when(F.col("span") < back + ahead, _row("VT-02", "features.lookback", F.lit(f"lookback and horizon need {back + ahead} s, more than the data span")))
        )
        rules.append(
            F.when(
                (usable > 0) & (windows < LEAST_WINDOWS) & F.lit(back > 0),
                _row("VT-03", "features.lookback", _text(F.round(windows).cast("bigint").cast("string"), f" windows, at least {LEAST_WINDOWS} needed")),
            )
        )
    return facts.select(F.inline(F.array_compact(F.array(*rules))))


def class_findings(df: DataFrame, target: str) -> DataFrame:
    """VE-01 to VE-03 on a label that is in the table, derived ones included; one VE-02 row per small class."""
    where = "features.target"
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    text = is_text(df.schema[target].dataType)
    classes = counts.agg(F.count("class").alias("k"), F.count_if(F.col("class").isNull()).alias("null_class"))
    wide = classes.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        (F.col("k") + F.col("null_class") > MAX_CLASSES) & F.lit(not text),
                        _row("VE-01", where, _text(f"{target} has ", (F.col("k") + F.col("null_class")).cast("string"), " distinct values")),
                    ),
                    F.when(
                        F.col("k") > MAX_CLASSES,
                        _row("VE-03", where, _text(F.col("k").cast("string"), f" classes, at most {MAX_CLASSES} allowed")),
                    ),
                )
            )
        )
    )
    small = counts.where(F.col("class").isNotNull() & (F.col("rows") < LEAST_CLASS_ROWS)).select(
        F.lit("VE-02").alias("code"),
        F.lit(where).alias("field"),
        _text("class ", F.col("class"), " has ", F.col("rows").cast("string"), f" rows, at least {LEAST_CLASS_ROWS} needed").alias("message"),
        F.lit("merge small classes or add data").alias("suggestion"),
    )
    return wide.unionByName(small)
