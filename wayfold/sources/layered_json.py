"""Layered JSON exports: one document with an array of snapshots and one of trajectories.

Field names are turned into column names on the driver from the schema alone; the
rows see one ``explode`` and one projection. Where fields vary by row (maps, variants),
one aggregation over the rows finds the names first.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.model import Dataset
from wayfold.session import cut_lineage
from wayfold.sources.open_records import as_map, field, is_open, open_projection, spread
from wayfold.sources.split_json import split_records

# Names in the export and the column names they get.
SNAPSHOT_LAYERS = ("state_snapshots", "snapshots")
SNAPSHOT_NAMES = {
    "timestamp": "ts",
    "bucket_index": "bucket_idx",
    "sys_wip": "wip",
    "sys_total_in_queue": "in_queue",
    "sys_total_busy": "busy",
    "sys_cumulative_arrivals": "cum_arrivals",
    "sys_cumulative_completions": "cum_completions",
    "sys_arrival_rate_per_hour": "arrival_rate",
    "sys_throughput_per_hour": "throughput",
    "sys_wip_ratio": "wip_ratio",
    "sys_avg_wait_time": "avg_wait",
    "sys_avg_processing_time": "avg_processing",
    "sys_wait_cost_in_bucket": "wait_cost_bucket",
    "sys_idle_cost_in_bucket": "idle_cost_bucket",
    "sys_revenue_in_bucket": "revenue_bucket",
    "sys_cumulative_wait_cost": "cum_wait_cost",
    "sys_cumulative_idle_cost": "cum_idle_cost",
    "sys_cumulative_revenue": "cum_revenue",
    "sys_cumulative_net_cost": "cum_net_cost",
    "sys_sla_breaches_in_bucket": "sla_breaches_bucket",
    "sys_cumulative_sla_breaches": "cum_sla_breaches",
    "sys_sla_compliance": "sla_compliance",
}
NODE_METRICS = {
    "queue": "queue",
    "busy": "busy",
    "concurrency": "concurrency",
    "utilization": "util",
    "cumulative_processed": "cum_processed",
    "arrivals_in_bucket": "arrivals_bucket",
    "completions_in_bucket": "completions_bucket",
    "throughput_per_hour": "throughput",
    "avg_wait_time": "avg_wait",
    "avg_processing_time": "avg_processing",
}
RESOURCE_METRICS = {"capacity": "capacity", "utilization": "util"}
TRAJECTORY_NAMES = {
    "entity_id": "eid",
    "entity_type": "etype",
    "entity_priority": "epriority",
    "source_index": "source_idx",
    "step_index": "step",
    "node_name": "node",
    "sim_time_enter": "t_enter",
    "sim_time_complete": "t_complete",
    "wait_time": "wait",
    "processing_time": "processing",
    "setup_time": "setup",
    "transit_time": "transit",
    "transport_cost": "transit_cost",
    "episode_done": "done",
    "episode_status": "status",
    "episode_total_time": "total_time",
    "attr_priority_class": "priority_class",
}
PASSED_PREFIXES = ("sla_", "domain_")
STATE_NAMES = {
    "entity_priority": "priority",
    "entity_elapsed_time": "elapsed",
    "entity_cumulative_wait": "cum_wait",
    "entity_cumulative_processing": "cum_processing",
    "entity_wait_ratio": "wait_ratio",
    "entity_steps_completed": "steps_done",
    "entity_cumulative_cost": "cum_cost",
    "entity_cumulative_transport_cost": "cum_transit_cost",
    "entity_cumulative_setup_time": "cum_setup",
    "entity_source_index": "source_idx",
    "node_utilization": "node_util",
    "node_avg_queue_depth": "node_avg_queue",
    "node_max_queue_depth": "node_max_queue",
    "node_avg_wait_time": "node_avg_wait",
    "node_avg_processing_time": "node_avg_processing",
    "node_throughput_per_hour": "node_throughput",
    "node_concurrency": "node_concurrency",
    "node_setup_count": "node_setup_count",
    "node_mutation_count": "node_mutation_count",
    "sys_utilization": "sys_util",
    "sys_throughput_per_hour": "sys_throughput",
    "sys_bottleneck_utilization": "sys_bottleneck_util",
    "sys_node_count": "sys_node_count",
    "sys_total_capacity": "sys_total_capacity",
}
REWARD_NAMES = (
    "time_penalty", "cost_penalty", "transport_cost_penalty", "step_completion", "sla_penalty",
    "processing_efficiency", "sla_budget_remaining", "episode_completion",
)
NESTED = ("state", "reward", "next_state")
STATE_RESOURCE_FORM = r"resource_([a-zA-Z0-9_]+?)_(utilization|capacity)"


def _metric(raw: str, prefix: str, short: str, metrics: dict[str, str]) -> str | None:
    """``prefix_<name>_<metric>``; the longest known metric ends the name, which may hold underscores itself."""
    if not raw.startswith(prefix):
        return None
    rest = raw.removeprefix(prefix)
    found = max((m for m in metrics if rest.endswith(f"_{m}") and len(rest) > len(m) + 1), key=len, default=None)
    return None if found is None else f"{short}_{rest.removesuffix(f'_{found}')}_{metrics[found]}"


def snapshot_name(raw: str) -> str | None:
    """Column name of a snapshot field, or None for an unknown one."""
    return (
        SNAPSHOT_NAMES.get(raw)
        or _metric(raw, "node_", "n", NODE_METRICS)
        or _metric(raw, "resource_", "r", RESOURCE_METRICS)
    )


def trajectory_name(raw: str) -> str | None:
    """Column name of a top-level trajectory field; limits and domain flags keep theirs."""
    return TRAJECTORY_NAMES.get(raw) or (raw if raw.startswith(PASSED_PREFIXES) else None)


def state_name(raw: str, prefix: str = "s") -> str | None:
    """Column name of a field of the state before (``s``) or after (``ns``) a step."""
    if raw in STATE_NAMES:
        return f"{prefix}_{STATE_NAMES[raw]}"
    resource = re.fullmatch(STATE_RESOURCE_FORM, raw)
    if resource:
        return f"{prefix}_r_{resource[1]}_{RESOURCE_METRICS[resource[2]]}"
    if raw.startswith("attr_") and raw != "attr_":
        return f"{prefix}_attr_{raw.removeprefix('attr_')}"
    return None


def reward_name(raw: str) -> str | None:
    return f"rw_{raw}" if raw in REWARD_NAMES else None


def _projection(names: list[str], rename, parent: str = "") -> list[Column]:
    dotted = f"`{parent}`." if parent else ""
    return [F.col(f"{dotted}`{n}`").alias(new) for n in names if (new := rename(n))]


def snapshots_layer(raw: DataFrame) -> DataFrame:
    """Rename known snapshot fields and drop the rest."""
    columns = _projection(raw.columns, snapshot_name)
    if not columns:
        raise ValueError("no known snapshot field")
    return raw.select(*columns)


def trajectories_layer(raw: DataFrame) -> DataFrame:
    """Rename known fields and flatten the nested state, reward and next state, be they structs, maps or variants."""
    columns = _projection(raw.columns, trajectory_name)
    nested = {
        "state": lambda n: state_name(n, "s"),
        "reward": reward_name,
        "next_state": lambda n: state_name(n, "ns"),
    }
    for parent, rename in nested.items():
        if parent in raw.columns and isinstance(raw.schema[parent].dataType, T.StructType):
            columns += _projection(raw.schema[parent].dataType.fieldNames(), rename, parent)
    varying = open_projection(raw, nested)
    if varying:
        # The map of a variant is made once and then read for each of its fields.
        parents = {p: f"{p}.fields" for p in dict.fromkeys(p for p, *_ in varying)}
        raw = raw.select("*", *[as_map(p, raw.schema[p].dataType).alias(m) for p, m in parents.items()])
        columns += [field(F.col(f"`{parents[p]}`"), n, dtype).alias(new) for p, n, new, dtype in varying]
    if not columns:
        raise ValueError("no known trajectory field")
    return raw.select(*columns)


def unknown_fields(raw: DataFrame, layer: str) -> list[str]:
    """Top-level fields of a raw layer that no column is made of."""
    if layer == "snapshots":
        return [n for n in raw.columns if snapshot_name(n) is None]
    return [n for n in raw.columns if trajectory_name(n) is None and n not in NESTED]


def _layer(document: DataFrame, name: str) -> DataFrame | None:
    if name not in document.columns:
        return None
    dtype = document.schema[name].dataType
    if not isinstance(dtype, T.ArrayType):
        return None
    if is_open(dtype.elementType):
        return spread(document.select(F.explode(name).alias("record")), "record", NESTED)
    return document.select(F.inline(F.col(name))) if isinstance(dtype.elementType, T.StructType) else None


# Every record as it comes, whatever its fields.
VARYING_RECORDS = ", ".join(
    ["metadata variant", "summary variant", *[f"{n} array<variant>" for n in (*SNAPSHOT_LAYERS, "trajectories")]]
)


def load_layered_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, document_per_line: bool = False, varying: bool = False,
    split: bool = False,
) -> Dataset:
    """Read one export, or a folder of them.

    A file is one document, parsed by one task, or with ``document_per_line`` many of
    them, which lets Spark split the file. With a ``schema`` nothing is inferred and
    only the layers asked for are parsed. ``varying`` reads records as variants: fields that
    differ from record to record become columns of a type that holds all their values,
    and no struct of all fields is inferred. A schema may also have maps or variants.
    ``split`` lets many tasks read one document, whose records are variants then, too.
    """
    if split:
        return _load_split(spark, path)
    if varying and schema is None:
        schema = VARYING_RECORDS
    reader = spark.read.option("multiLine", not document_per_line)
    document = (reader.schema(schema) if schema else reader).json(path)
    raw_snapshots = next((d for n in SNAPSHOT_LAYERS if (d := _layer(document, n)) is not None), None)
    raw_trajectories = _layer(document, "trajectories")
    told = [n for n in ("metadata", "summary") if n in document.columns and isinstance(document.schema[n].dataType, (T.StructType, T.VariantType))]
    # A row for each document with the file it comes from; the first by file name stands in the dataset's record.
    documents = document.select(F.input_file_name().alias("file"), *[F.to_json(F.col(n)).alias(n) for n in told])
    first = documents.orderBy("file", *told).first() if told else None
    extras = {n: first[n] for n in told if first[n] is not None} if first else {}
    return _dataset(raw_snapshots, raw_trajectories, path, extras, documents)


def _load_split(spark: SparkSession, path: str) -> Dataset:
    # Written once: the names of the fields and the rows of both layers are read from it.
    found = cut_lineage(split_records(spark, path), "records")

    def layer(name: str) -> DataFrame | None:
        rows = found.where((F.col("layer") == name) & F.col("in_array"))
        return spread(rows.select(F.parse_json("record").alias("record")), "record", NESTED)

    raw_snapshots = next((d for n in SNAPSHOT_LAYERS if (d := layer(n)) is not None), None)
    told = ("metadata", "summary")
    values = [F.max(F.when((F.col("layer") == n) & ~F.col("in_array"), F.col("record"))).alias(n) for n in told]
    documents = found.groupBy("file").agg(*values)
    first = documents.orderBy("file").first()
    extras = {n: first[n] for n in told if first and first[n] is not None}
    return _dataset(raw_snapshots, layer("trajectories"), path, extras, documents)


def _dataset(raw_snapshots: DataFrame | None, raw_trajectories: DataFrame | None, path: str, extras: dict[str, str], documents: DataFrame) -> Dataset:
    if raw_snapshots is None and raw_trajectories is None:
        raise ValueError(f"neither snapshots nor trajectories in {path}")
    if raw_snapshots is not None:
        extras["unknown_snapshot_fields"] = json.dumps(unknown_fields(raw_snapshots, "snapshots"))
    if raw_trajectories is not None:
        extras["unknown_trajectory_fields"] = json.dumps(unknown_fields(raw_trajectories, "trajectories"))
    return Dataset(
        None if raw_snapshots is None else snapshots_layer(raw_snapshots),
        None if raw_trajectories is None else trajectories_layer(raw_trajectories),
        "layered_json",
        path,
        extras,
        documents,
    )
