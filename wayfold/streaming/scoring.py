"""Score rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.plans.training import FittedModel, predict


def scored_stream(rows: DataFrame, fitted: FittedModel, model_id: str) -> DataFrame:
    """Adds prediction, probabilities, model id and time; stateless, so any number of tasks can share it."""
    return predict(rows, fitted).select(
        "*", F.lit(model_id).alias("model_id"), F.current_timestamp().alias("scored_at")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet exactly once; with ``available_now`` stop when the input at hand is done."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)
