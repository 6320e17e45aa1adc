"""Time as numbers, whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.model import is_numeric


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 as DOUBLE for a number, a date or a timestamp with or without zone."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if is_numeric(dtype):
        return column.cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column) / F.lit(1_000_000.0)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return ntz_seconds(column.cast("timestamp_ntz")).cast("double")
    raise ValueError(f"column {name!r} is not a time: {dtype.simpleString()}")


def ntz_seconds(column: Column) -> Column:
    """Seconds with microseconds (DECIMAL) of a zone-less timestamp; no zone rule is consulted."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (column - origin).cast("interval second").cast("decimal(20,6)")


def ntz_micros(column: Column) -> Column:
    return (ntz_seconds(column) * 1_000_000).cast("bigint")
