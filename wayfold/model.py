"""Names, defaults and small records shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column groups and outcome columns every result depends on.
ENTITY_STATE = (
    "s_priority", "s_elapsed", "s_cum_wait", "s_cum_processing", "s_wait_ratio",
    "s_steps_done", "s_cum_cost", "s_cum_transit_cost", "s_cum_setup", "s_source_idx",
)
NODE_STATE = (
    "s_node_util", "s_node_avg_queue", "s_node_max_queue", "s_node_avg_wait", "s_node_avg_processing",
    "s_node_throughput", "s_node_concurrency", "s_node_setup_count", "s_node_mutation_count",
)
SYSTEM_STATE = (
    "s_sys_util", "s_sys_throughput", "s_sys_bottleneck_util", "s_sys_node_count", "s_sys_total_capacity",
)
OUTCOME_COLUMNS = (
    "total_time", "done", "status", "rw_episode_completion", "rw_step_completion",
    "rw_sla_budget_remaining", "rw_sla_penalty", "t_complete",
)
IDENTIFIER_COLUMNS = (
    "eid", "etype", "node", "done", "status", "total_time", "t_enter", "t_complete", "epriority", "source_idx",
)
DERIVED_LABELS = ("sla_breach", "delay_severity", "wait_ratio_class")
PREFERRED_LIMITS = ("sla_standard_visit_limit", "sla_resolution_limit", "sla_order_completion_limit")
STRUCTURAL_SERIES_COLUMNS = ("ts", "bucket_idx")
UNKNOWN = "unknown"

# Settings that apply when the caller names none.
SERIES_DEFAULTS = {
    "target": "avg_wait",
    "lookback": "4h",
    "horizon": "1h",
    "lags": ("1h", "2h", "4h"),
    "rolling": ("2h", "4h"),
    "folds": 5,
    "metrics": ("rmse", "mae", "mape"),
    "algorithms": ("gbt",),
    "balance": False,
    "trials": 20,
    "seed": 42,
}
ENTITY_DEFAULTS = {
    "target": "status",
    "observe": "all_steps",
    "folds": 5,
    "metrics": ("f1_weighted", "auc_roc", "precision", "recall"),
    "algorithms": ("gbt",),
    "balance": True,
    "trials": 20,
    "seed": 42,
}

MAX_CLASSES = 20


@dataclass(frozen=True)
class Dataset:
    """One or two layers of the same operation; at least one must be there."""

    snapshots: DataFrame | None = None
    trajectories: DataFrame | None = None
    source_type: str = ""
    source_path: str = ""
    extras: dict = field(default_factory=dict)
    documents: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.snapshots is None and self.trajectories is None:
            raise ValueError("a dataset needs a snapshots or a trajectories layer")

    def layers(self) -> dict[str, DataFrame]:
        present = {"snapshots": self.snapshots, "trajectories": self.trajectories}
        return {name: df for name, df in present.items() if df is not None}


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.TimeType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {missing}")
