"""Learners by name as ``pyspark.ml`` estimators, and their search spaces."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

REGRESSION, CLASSIFICATION = "regression", "classification"

# Settings of the learners and the ranges searched.
FOREST = {"numTrees": 300, "maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"}
BOOSTING = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8}
RIDGE_ALPHA = 1.0
LOGISTIC = {"maxIter": 1000}
SPACES = {
    "gbt": {
        "maxIter": ("int", 100, 1000, 100),
        "stepSize": ("log", 0.01, 0.3),
        "maxDepth": ("int", 3, 10, 1),
        "subsamplingRate": ("float", 0.5, 1.0),
        "minInstancesPerNode": ("int", 5, 100, 1),
    },
    "random_forest": {
        "numTrees": ("int", 100, 500, 100),
        "maxDepth": ("int", 4, 20, 1),
        "minInstancesPerNode": ("int", 1, 10, 1),
        "featureSubsetStrategy": ("choice", ("sqrt", "log2")),
    },
    "linear_regression": {"alpha": ("log", 1e-4, 100.0)},
    "linear_classification": {"C": ("log", 1e-4, 100.0), "maxIter": ("choice", (500, 1000, 2000))},
}


# Boosting writes its state to the checkpoint folder so often.
CHECKPOINT_ROUNDS = 10


@dataclass(frozen=True)
class Facts:
    """What a learner may need to know of its training rows: their number, and the target's spread."""

    rows: int
    label_std: float = 1.0
    classes: int = 2


@dataclass(frozen=True)
class Learner:
    """Builds an estimator for a task; ``weighted`` learners balance classes whatever the caller asks.

    The last argument names a boolean column of rows that iterative learners watch to stop early, or is None.
    """

    name: str
    build: Callable[[str, Facts, int, dict, str | None], Estimator]
    tasks: tuple[str, ...] = (REGRESSION, CLASSIFICATION)
    always_balanced: bool = True
    space: Callable[[str], dict] = field(default=lambda task: {})


def _common(weighted: bool) -> dict:
    return {"featuresCol": "features", "labelCol": "label", **({"weightCol": "weight"} if weighted else {})}


def _linear(task: str, facts: Facts, seed: int, settings: dict, held: str | None = None) -> Estimator:
    if task == REGRESSION:
        alpha = settings.get("alpha", RIDGE_ALPHA)
        # This scaling of the penalty makes the fit equal to ridge regression with ``alpha``.
        penalty = alpha * facts.label_std / facts.rows if facts.rows else 0.0
        return LinearRegression(
            **_common(False), elasticNetParam=0.0, standardization=False, solver="normal", regParam=penalty
        )
    chosen = {**LOGISTIC, **{k: v for k, v in settings.items() if k == "maxIter"}}
    strength = settings.get("C", 1.0)
    # The penalty falls on the coefficients of the raw features.
    return LogisticRegression(**_common(True), standardization=False, regParam=1.0 / (strength * max(facts.rows, 1)), **chosen)


def _forest(task: str, facts: Facts, seed: int, settings: dict, held: str | None = None) -> Estimator:
    # Each row's node in each tree is kept between levels; otherwise every level sends all trees to the tasks and walks them from the root.
    chosen = {"cacheNodeIds": True, **FOREST, **settings, "seed": seed}
    if task == REGRESSION:
        return RandomForestRegressor(**_common(False), **chosen)
    return RandomForestClassifier(**_common(True), **chosen)


def _boosting(task: str, facts: Facts, seed: int, settings: dict, held: str | None = None) -> Estimator:
    # One against the rest does not hand the column on, so with more classes all rounds are run.
    stop = {"validationIndicatorCol": held} if held and facts.classes <= 2 else {}
    chosen = {**BOOSTING, **settings, **stop, "seed": seed, "checkpointInterval": CHECKPOINT_ROUNDS}
    if task == REGRESSION:
        return GBTRegressor(**_common(False), **chosen)
    binary = GBTClassifier(**_common(True), **chosen)
    if facts.classes <= 2:
        return binary
    return OneVsRest(classifier=binary, featuresCol="features", labelCol="label", weightCol="weight", parallelism=2)


class Learners:
    """Learners by name; a name can be taken once."""

    def __init__(self) -> None:
        self._known: dict[str, Learner] = {}
        self._aliases: dict[str, str] = {}

    def register(self, learner: Learner) -> None:
        if learner.name in self._known:
            raise ValueError(f"learner {learner.name!r} exists already")
        self._known[learner.name] = learner

    def alias(self, other: str, name: str) -> None:
        """``other`` is one more name of the learner ``name``."""
        if other in self._known or other in self._aliases:
            raise ValueError(f"learner {other!r} exists already")
        self._aliases[other] = self.get(name).name

    def get(self, name: str) -> Learner:
        found = self._known.get(self._aliases.get(name, name))
        if found is None:
            raise KeyError(f"no learner {name!r}")
        return found

    def names(self) -> list[str]:
        """Every name that :meth:`get` knows."""
        return sorted([*self._known, *self._aliases])


def default_learners() -> Learners:
    found = Learners()
    found.register(Learner("gbt", _boosting, space=lambda task: SPACES["gbt"]))
    found.register(Learner("random_forest", _forest, space=lambda task: SPACES["random_forest"]))
    # Fixed names under which settings from elsewhere ask for gradient-boosted trees.
    for other in ("lightgbm", "xgboost"):
        found.alias(other, "gbt")
    found.register(Learner("linear", _linear, space=lambda task: SPACES[f"linear_{task}"]))
    return found


def sample_settings(space: dict, trials: int, seed: int) -> list[dict]:
    """``trials`` random draws from a space, the same ones for the same seed."""
    draw = random.Random(seed)
    return [{name: _draw(draw, rule) for name, rule in space.items()} for _ in range(trials)]


def _draw(draw: random.Random, rule: tuple):
    kind, *limits = rule
    if kind == "choice":
        return draw.choice(limits[0])
    low, high = limits[0], limits[1]
    if kind == "int":
        return low + limits[2] * draw.randint(0, (high - low) // limits[2])
    if kind == "log":
        return low * (high / low) ** draw.random()
    return draw.uniform(low, high)
