"""Snapshots of an event stream, one row per closed time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.time import epoch_seconds
from wayfold.sources.event_tables import bucket_measures


def bucketed(events: DataFrame, bucket: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Rows per tumbling bucket of ``ts``; works on a stream and on a table.

    A bucket comes out once the watermark has passed its end; later rows for it are
    dropped. State is one small row per open bucket, combined map-side.
    """
    # Watermarks need an instant; a time without zone is read as UTC, whatever the session's zone.
    instant = F.timestamp_micros(F.round(epoch_seconds(events, "ts") * 1_000_000).cast("bigint"))
    timed = events.withColumn("ts", instant).withWatermark("ts", lateness)
    grouped = timed.groupBy(F.window("ts", bucket).alias("w")).agg(*bucket_measures())
    return grouped.select(F.unix_seconds(F.col("w.start")).alias("ts"), *[c for c in grouped.columns if c != "w"])
