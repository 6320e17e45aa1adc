"""The end of a finite stream: what a watermark still holds open comes out.

A watermark only moves with later rows, so the last buckets of a stream that ends would never close. A closable stream is a union with a
second source, a folder that stays empty until :func:`end_of_input` writes one marker row later than any event. The next run of the
same query, from the same checkpoint, moves the watermark past every bucket. The marker's own bucket never closes, so nothing of it comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.streaming.scoring import append_to

# Later than any event; rows that come after it are late.
END = "9999-12-30 00:00:00"


def closable(events: DataFrame, folder: str) -> DataFrame:
    """``events`` and, once it is written, the marker of their end in ``folder``."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(folder)
    return events.unionByName(spark.readStream.schema(_nullable(events.schema)).parquet(folder))


def end_of_input(spark: SparkSession, folder: str, schema: T.StructType, time: str = "ts") -> None:
    """Say that no more events will come: one row with nothing but a time."""
    marker = [F.lit(END).cast("timestamp_ntz").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*marker).write.mode("append").parquet(folder)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def run_to_end(stream: DataFrame, events: T.StructType, folder: str, path: str, state: str, time: str = "ts") -> None:
    """Process what there is, mark the end and process that: ``stream`` is made of ``closable(events, folder)`` and written to ``path``."""
    append_to(stream, path, state).awaitTermination()
    end_of_input(stream.sparkSession, folder, events, time)
    append_to(stream, path, state).awaitTermination()
