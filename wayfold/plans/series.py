"""Snapshots to a supervised feature table for forecasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.durations import steps
from wayfold.functions.encode import Encoding
from wayfold.functions.ratios import imbalance, node_columns, queue_to_busy
from wayfold.functions.time import epoch_seconds
from wayfold.model import SERIES_DEFAULTS, require_columns
from wayfold.operators.blocks import ROWS_PER_BLOCK, OrderedRows, ordered_rows
from wayfold.operators.selection import series_sources
from wayfold.operators.series import (
    Interval,
    bucket_interval,
    lag,
    rolling_mean,
    rolling_std,
    target_ahead,
    trend,
    with_running_sums,
)
from wayfold.plans.entity import FeatureTable


def prepared(
    snapshots: DataFrame,
    series: list[str] | None,
    before: int,
    after: int,
    rows: int,
    rows_per_block: int = ROWS_PER_BLOCK,
    split: bool | None = None,
) -> OrderedRows:
    """Snapshots in time order, with ``_row`` numbering the rows of each window for slopes."""
    timed = snapshots.withColumn("ts", epoch_seconds(snapshots, "ts"))
    ready = ordered_rows(timed, series or [], ["ts"], before, after, rows_per_block, rows, split)
    return ready.select(F.row_number().over(ready.window).alias("_row"))


def series_table(
    snapshots: DataFrame,
    target: str = SERIES_DEFAULTS["target"],
    lookback: str = SERIES_DEFAULTS["lookback"],
    horizon: str = SERIES_DEFAULTS["horizon"],
    lags: tuple[str, ...] = SERIES_DEFAULTS["lags"],
    rolling: tuple[str, ...] = SERIES_DEFAULTS["rolling"],
    with_trend: bool = True,
    with_ratios: bool = True,
    with_cross_node: bool = True,
    with_delta: tuple[str, ...] = (),
    columns: list[str] | None = None,
    exclude: list[str] | None = None,
    series: list[str] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    split: bool | None = None,
    on_gap: str = "warn",
    interval: Interval | None = None,
) -> FeatureTable:
    """Lags, rolling statistics, slopes, ratios and the target ``horizon`` ahead; rows with a gap in any are dropped.

    All windows share one order, so one exchange and one sort serve every column.
    """
    require_columns(snapshots, "ts", target)
    spacing = interval or bucket_interval(snapshots, "ts", series, on_gap)
    back, ahead = steps(lookback, spacing.seconds), steps(horizon, spacing.seconds)
    lag_steps = {d: steps(d, spacing.seconds) for d in lags}
    roll_steps = {d: steps(d, spacing.seconds, 2) for d in rolling}
    delta_steps = {d: steps(d, spacing.seconds) for d in with_delta}
    sources = series_sources(snapshots, target, columns, [*(exclude or []), *(series or [])])
    reach = max([back, *lag_steps.values(), *roll_steps.values(), *delta_steps.values()])

    needed = list(dict.fromkeys(["ts", *(series or []), *sources, target]))
    ready = prepared(snapshots.select(*needed), series, reach, ahead, spacing.rows, rows_per_block, split)
    longest = max([*roll_steps.values(), back if with_trend else 0], default=0)
    ready = with_running_sums(ready, {c: longest for c in sources})
    built = _window_features(ready.window, sources, lag_steps, roll_steps, back if with_trend else 0, delta_steps)
    if with_ratios and {"in_queue", "busy"} <= set(sources):
        built["queue_to_busy_ratio"] = queue_to_busy()
    if with_cross_node:
        for name, metric in (("queue_imbalance", "queue"), ("util_imbalance", "util")):
            nodes = node_columns(sources, metric)
            if len(nodes) >= 2:
                built[name] = imbalance(nodes)
    ahead_name = f"{target}_target"
    built[ahead_name] = target_ahead(target, ready.window, ahead)

    rows = ready.select(*[c.alias(n) for n, c in built.items()]).finish()
    features = tuple(n for n in built if n != ahead_name)
    keys = (*(series or []), "ts")
    # A slope over a single step is never defined, so it does not decide which rows stay.
    decisive = [n for n in built if not (back < 2 and n.endswith("_trend"))]
    kept = rows.dropna(subset=decisive).select(*keys, *built, F.col(ahead_name).cast("double").alias("label"))
    return FeatureTable(kept, keys, features, target, Encoding("regression"))


def _window_features(
    w: WindowSpec,
    sources: list[str],
    lag_steps: dict[str, int],
    roll_steps: dict[str, int],
    back: int,
    delta_steps: dict[str, int],
) -> dict[str, Column]:
    built = {f"{c}_lag_{d}": lag(c, w, k) for c in sources for d, k in lag_steps.items()}
    for c in sources:
        for d, k in roll_steps.items():
            built[f"{c}_rmean_{d}"] = rolling_mean(c, w, k)
            built[f"{c}_rstd_{d}"] = rolling_std(c, w, k)
    if back:
        built |= {f"{c}_trend": trend(c, w, back) for c in sources}
    built |= {f"{c}_delta_{d}": F.col(c) - lag(c, w, k) for c in sources for d, k in delta_steps.items()}
    return built
