"""One registered query, and the SQL and table helpers that areas share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.blocks import ROWS_PER_BLOCK
from wayfold.sources.event_tables import table, trajectories

# About this many blocks, so that the path taken on a cluster is compared on small tables too.
CHECKED_BLOCKS = 5

# Results of short decimals often end in a 5 right behind the last place kept, where the last
# bit decides the rounding; adding this on both sides steps off such ties.
OFF_TIES = 1.2345678e-8


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def split_block(rows: int) -> int:
    """Rows per block that really splits a small table and is the usual size on a large one."""
    return min(ROWS_PER_BLOCK, max(40, rows // CHECKED_BLOCKS))


def event_block(spark: SparkSession, folder: str) -> int:
    return split_block(table(spark, folder, "events").count())


def split_journeys(spark: SparkSession, folder: str) -> DataFrame:
    return trajectories(spark, folder, event_block(spark, folder), True)


def plain_journeys(spark: SparkSession, folder: str) -> DataFrame:
    return trajectories(spark, folder)


# The trajectories and snapshots of the event table, for DuckDB.
JOURNEYS = """
ev AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS eid, event_id, epoch_us(ts) AS micros, event_type AS node, value
  FROM events),
ev_steps AS (
  SELECT *, row_number() OVER w - 1 AS step,
    coalesce((micros - lag(micros) OVER w) / 1e6, 0e0) AS wait,
    value * 60 AS processing,
    lead(event_id) OVER w IS NULL AS is_last
  FROM ev WINDOW w AS (PARTITION BY eid ORDER BY micros, event_id)),
ev_sums AS (
  SELECT *, sum(wait) OVER c AS s_cum_wait, sum(processing) OVER c AS s_cum_processing, sum(value) OVER c AS s_cum_cost,
    is_last AND node <> 'error' AS done
  FROM ev_steps WINDOW c AS (PARTITION BY eid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tr AS (
  SELECT eid, CAST(step AS BIGINT) AS step, node, wait, processing, done,
    CASE WHEN done THEN s_cum_wait + s_cum_processing END AS total_time,
    CASE WHEN done THEN 'completed' WHEN is_last THEN 'failed' END AS status,
    micros / 1e6 AS t_enter, s_cum_wait, s_cum_processing, s_cum_wait AS s_elapsed,
    CAST(step AS BIGINT) AS s_steps_done, s_cum_cost, value / 100 AS s_node_util,
    event_id % 7 AS s_node_avg_queue, (event_id % 10) / 10e0 AS s_sys_util, CAST(5 AS BIGINT) AS s_sys_node_count
  FROM ev_sums)"""

SNAPSHOTS = """
bu AS (
  SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) * 3600 AS ts, event_type, value FROM events),
filled AS (
  SELECT ts, count(*) AS arrivals,
    count(*) FILTER (event_type = 'click') AS n_click_queue,
    count(*) FILTER (event_type = 'error') AS n_error_queue,
    count(*) FILTER (event_type = 'purchase') AS n_purchase_queue,
    count(*) FILTER (event_type = 'signup') AS n_signup_queue,
    count(*) FILTER (event_type = 'view') AS n_view_queue,
    count(*) FILTER (event_type = 'view') AS in_queue,
    count(*) FILTER (event_type = 'click') AS busy,
    avg(value) AS avg_wait
  FROM bu GROUP BY ts),
grid AS (
  SELECT unnest(range((SELECT min(ts) FROM bu), (SELECT max(ts) FROM bu) + 1, 3600)) AS ts),
sn AS (
  SELECT CAST(g.ts AS BIGINT) AS ts, CAST(g.ts // 3600 AS BIGINT) AS bucket_idx,
    coalesce(arrivals, 0) AS arrivals, coalesce(n_click_queue, 0) AS n_click_queue,
    coalesce(n_error_queue, 0) AS n_error_queue, coalesce(n_purchase_queue, 0) AS n_purchase_queue,
    coalesce(n_signup_queue, 0) AS n_signup_queue, coalesce(n_view_queue, 0) AS n_view_queue,
    coalesce(in_queue, 0) AS in_queue, coalesce(busy, 0) AS busy, coalesce(avg_wait, 0e0) AS avg_wait
  FROM grid g LEFT JOIN filled f ON g.ts = f.ts)"""


def nearest_sql(column: str, source: str, fraction: str) -> str:
    """The nearest-rank quantile of the non-null values, as a scalar subquery."""
    return (
        f"(SELECT x FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS k, count(*) OVER () AS n "
        f"FROM {source} WHERE {column} IS NOT NULL) WHERE k = floor({fraction} * (n - 1) + 0.5e0))"
    )


