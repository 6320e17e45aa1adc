"""Snapshots and trajectories built from a plain event table.

``events(event_id, ts, user_id, event_type, value, props)`` gives one journey per user
and day (trajectories) and one row per time bucket (snapshots).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.time import ntz_micros
from wayfold.operators.blocks import ROWS_PER_BLOCK, ordered_rows

# The event types of the event table; they play the role of nodes.
NODES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trajectories(
    spark: SparkSession, folder: str, rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None
) -> DataFrame:
    return trajectories_from(table(spark, folder, "events"), rows_per_block, split)


def trajectories_from(events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, split: bool | None = None) -> DataFrame:
    """A journey is one user's events of one day in time order; it completes unless it ends in an error."""
    steps = events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("eid"),
        F.col("event_id"),
        ntz_micros(F.col("ts").cast("timestamp_ntz")).alias("micros"),
        F.col("event_type").alias("node"),
        F.col("value"),
    )
    rows = ordered_rows(
        steps, ["eid"], ["micros", "event_id"], before=1, after=1, rows_per_block=rows_per_block,
        rows=events.count(), split=split,
    )
    w = rows.window
    rows = rows.select(
        ((F.col("micros") - F.lag("micros").over(w)) / F.lit(1_000_000.0)).alias("_gap"),
        F.lead("event_id").over(w).isNull().alias("_last"),
    ).select(F.coalesce("_gap", F.lit(0.0)).alias("wait"), (F.col("value") * 60).alias("processing"))
    rows = rows.running_sums(
        {
            "_n": F.lit(1),
            "s_cum_wait": F.col("wait"),
            "s_cum_processing": F.col("processing"),
            "s_cum_cost": F.col("value"),
        }
    )
    done = F.col("_last") & (F.col("node") != "error")
    return rows.finish().select(
        "eid",
        (F.col("_n") - 1).cast("bigint").alias("step"),
        "node",
        "wait",
        "processing",
        done.alias("done"),
        F.when(done, F.col("s_cum_wait") + F.col("s_cum_processing")).alias("total_time"),
        F.when(done, F.lit("completed")).otherwise(F.when(F.col("_last"), F.lit("failed"))).alias("status"),
        (F.col("micros") / F.lit(1_000_000.0)).alias("t_enter"),
        "s_cum_wait",
        "s_cum_processing",
        F.col("s_cum_wait").alias("s_elapsed"),
        (F.col("_n") - 1).cast("bigint").alias("s_steps_done"),
        "s_cum_cost",
        (F.col("value") / 100).alias("s_node_util"),
        (F.col("event_id") % 7).alias("s_node_avg_queue"),
        ((F.col("event_id") % 10) / F.lit(10.0)).alias("s_sys_util"),
        F.lit(len(NODES)).alias("s_sys_node_count"),
    )


def snapshots(spark: SparkSession, folder: str, bucket_seconds: int = 3600) -> DataFrame:
    return snapshots_from(table(spark, folder, "events"), bucket_seconds)


def bucket_measures() -> list:
    """The aggregates of one bucket; batch and streaming share them."""
    typed = [F.count_if(F.col("event_type") == n).cast("bigint").alias(f"n_{n}_queue") for n in NODES]
    return [
        F.count(F.lit(1)).cast("bigint").alias("arrivals"),
        *typed,
        F.count_if(F.col("event_type") == "view").cast("bigint").alias("in_queue"),
        F.count_if(F.col("event_type") == "click").cast("bigint").alias("busy"),
        F.avg("value").alias("avg_wait"),
    ]


def snapshots_from(events: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """One row per bucket from the first to the last; an empty bucket has zero counts and no average."""
    micros = ntz_micros(F.col("ts").cast("timestamp_ntz"))
    bucket = (F.floor(micros / (bucket_seconds * 1_000_000)) * bucket_seconds).cast("bigint")
    filled = events.select(bucket.alias("ts"), "event_type", "value").groupBy("ts").agg(*bucket_measures())
    ends = events.agg(F.min(bucket).alias("first"), F.max(bucket).alias("last")).first()
    # A range is made in many tasks, where an exploded sequence would be made in one.
    first, stop = (0, 0) if ends["first"] is None else (ends["first"], ends["last"] + bucket_seconds)
    grid = events.sparkSession.range(first, stop, bucket_seconds).withColumnRenamed("id", "ts")
    counts = [c for c in filled.columns if c not in ("ts", "avg_wait")]
    return grid.join(filled, "ts", "left").select(
        "ts",
        F.floor(F.col("ts") / bucket_seconds).cast("bigint").alias("bucket_idx"),
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("avg_wait", F.lit(0.0)).alias("avg_wait"),
    )
