"""Named feature definitions that compile to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.durations import steps
from wayfold.functions.ratios import guarded
from wayfold.operators.blocks import OrderedRows
from wayfold.operators.series import lag, rolling_mean, rolling_std, trend, with_running_sums

# Fixed names of the kinds.
KINDS = ("lag", "rolling_mean", "rolling_std", "trend", "ratio", "derived")


@dataclass(frozen=True)
class FeatureDefinition:
    """A feature by name: its source column, one of :data:`KINDS`, and parameters.

    ``duration`` (lag, rolling, trend), ``denominator`` and ``otherwise`` (ratio), ``expression`` (derived).
    """

    name: str
    source: str
    kind: str
    parameters: dict = field(default_factory=dict)
    description: str = ""

    def reach(self, interval: float) -> int:
        """How many rows back the feature looks."""
        if self.kind not in ("lag", "rolling_mean", "rolling_std", "trend"):
            return 0
        return steps(self.parameters["duration"], interval, 1 if self.kind in ("lag", "trend") else 2)

    def column(self, window: WindowSpec | None = None, interval: float = 1.0) -> Column:
        k = self.reach(interval)
        if self.kind == "ratio":
            built = guarded(self.source, self.parameters["denominator"], float(self.parameters.get("otherwise", 0.0)))
        elif self.kind == "derived":
            built = F.expr(self.parameters["expression"])
        elif window is None:
            raise ValueError(f"feature {self.name!r} needs a window")
        else:
            build = {"lag": lag, "rolling_mean": rolling_mean, "rolling_std": rolling_std, "trend": trend}[self.kind]
            built = build(self.source, window, k)
        return built.alias(self.name)


class FeatureStore:
    """Definitions by name."""

    def __init__(self) -> None:
        self._known: dict[str, FeatureDefinition] = {}

    def register(self, definition: FeatureDefinition) -> str:
        if definition.kind not in KINDS:
            raise ValueError(f"unknown kind {definition.kind!r}; known: {list(KINDS)}")
        self._known[definition.name] = definition
        return definition.name

    def get(self, name: str) -> FeatureDefinition:
        if name not in self._known:
            raise KeyError(f"no feature {name!r}")
        return self._known[name]

    def has(self, name: str) -> bool:
        return name in self._known

    def definitions(self) -> list[FeatureDefinition]:
        return list(self._known.values())

    def reach(self, names: list[str], interval: float) -> int:
        return max((self.get(n).reach(interval) for n in names), default=0)

    def columns(self, names: list[str], window: WindowSpec | None, interval: float) -> list[Column]:
        """All named features, to be put in one projection."""
        return [self.get(n).column(window, interval) for n in names]

    def added(self, rows: OrderedRows, names: list[str], interval: float) -> OrderedRows:
        """``rows`` with all named features, long frames at a constant cost for each row."""
        frames: dict[str, int] = {}
        for d in map(self.get, names):
            if d.kind in ("rolling_mean", "rolling_std", "trend"):
                frames[d.source] = max(frames.get(d.source, 0), d.reach(interval))
        return with_running_sums(rows, frames).select(*self.columns(names, rows.window, interval))
