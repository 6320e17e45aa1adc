"""Durations written as a number and a unit: ``30s``, ``5m``, ``1.5h``, ``1d``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit and the accepted form.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DURATION_FORM = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([smhdSMHD])\s*$"


def seconds(text: str) -> int:
    """Whole seconds of a duration, rounded down."""
    match = re.match(DURATION_FORM, text)
    if match is None:
        raise ValueError(f"not a duration (number and s, m, h or d): {text!r}")
    return int(float(match[1]) * UNIT_SECONDS[match[2].lower()])


def seconds_column(text: Column) -> Column:
    """Same for a string column; null where the text is not a duration."""
    number = F.regexp_extract(text, DURATION_FORM, 1)
    unit = F.lower(F.regexp_extract(text, DURATION_FORM, 2))
    factor = F.create_map(*[F.lit(v) for pair in UNIT_SECONDS.items() for v in pair])[unit]
    return F.when(number != "", F.floor(number.try_cast("double") * factor)).cast("bigint")


def steps(text: str, interval: float, least: int = 1) -> int:
    """Rows a duration spans when rows are ``interval`` seconds apart."""
    return max(least, int(seconds(text) / interval))
