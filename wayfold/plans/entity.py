"""Trajectories to a labelled feature table, one row per observed step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.encode import Encoding, encoding_of
from wayfold.functions.ratios import entity_ratios
from wayfold.model import DERIVED_LABELS, require_columns
from wayfold.operators.labels import derive
from wayfold.operators.observation import drop_unknown, observe
from wayfold.operators.selection import entity_features


ROW_KEY = "row_key"


@dataclass(frozen=True)
class FeatureTable:
    """Feature rows with key columns and ``label``; ``features`` keeps the column order."""

    rows: DataFrame
    keys: tuple[str, ...]
    features: tuple[str, ...]
    target: str
    encoding: Encoding


def labelled_steps(
    trajectories: DataFrame, target: str, point: str = "all_steps", tie: str = "half_up", **label_options: object
) -> DataFrame:
    """Observed steps with a known outcome in column ``target``."""
    if target not in DERIVED_LABELS:
        require_columns(trajectories, target)
        return observe(trajectories, point, tie)
    # Labels come from all steps, rows only from the observed ones. The midpoint needs
    # no detour: the label join keeps every step, so either order gives the same rows.
    return observe(drop_unknown(derive(trajectories, target, **label_options), target), point, tie)


def feature_columns(df: DataFrame, target: str, skip_ratios: tuple[str, ...] = (), **selection: object) -> DataFrame:
    """Keys, selected features with null as 0, and the derived ratios, in one projection."""
    selected = entity_features(df, target, **selection)
    ratios = entity_ratios(df.columns, skip_ratios)
    if not selected and not ratios:
        raise ValueError("no numeric feature column found")
    keys = [F.col(c) for c in ("eid", "step") if c in df.columns]
    if not keys:
        # Rows without a key of their own are told apart by their content; rows equal in all columns share a fold.
        keys = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW_KEY)]
    return df.where(F.col(target).isNotNull()).select(
        *keys,
        *[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in selected],
        *[F.coalesce(expr, F.lit(0.0)).alias(name) for name, expr in ratios.items()],
        target,
    )


def entity_table(
    trajectories: DataFrame,
    target: str = "status",
    point: str = "all_steps",
    tie: str = "half_up",
    label_options: dict | None = None,
    skip_ratios: tuple[str, ...] = (),
    **selection: object,
) -> FeatureTable:
    """The whole chain: label, observation point, columns, ratios, encoding, null fill."""
    steps = labelled_steps(trajectories, target, point, tie, **(label_options or {}))
    rows = feature_columns(steps, target, skip_ratios, **selection)
    encoding = encoding_of(rows, target)
    if encoding.classes is not None and not encoding.classes:
        raise ValueError(f"no row is left after observing {point!r}")
    keys = tuple(c for c in ("eid", "step") if c in rows.columns) or (ROW_KEY,)
    features = tuple(c for c in rows.columns if c not in (*keys, target))
    return FeatureTable(encoding.add(rows, target, "label"), keys, features, target, encoding)
