"""Bounded buffers and reproducible samples of transitions.

All three are "the n largest by some key". A small n is a per-task top-n merge; a large
one is a filter at the exact n-th value, so no single task ever holds the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.hashing import uniform
from wayfold.functions.names import free_name
from wayfold.operators.quantile import BRACKET_LIMIT, values_at_ranks

# A result up to this many rows is merged from each task's best; both ways give the same rows.
SMALL = 10_000
# Bytes of a text that are compared as one number.
_TEXT_STEP = 6


def largest(df: DataFrame, n: int, key: Column, ties: Column, small: int = SMALL, bracket_limit: int = BRACKET_LIMIT) -> DataFrame:
    """The ``n`` rows with the largest numeric ``key``, null keys last; the smaller ``ties`` decides among equal keys.

    There are never more than ``n``, and fewer only if ``df`` has fewer.
    """
    if n <= 0:
        return df.limit(0)
    own = free_name(df, "_key")
    keyed = df.withColumn(own, key.cast("double"))
    if n <= small:
        return keyed.orderBy(F.desc_nulls_last(own), ties).limit(n).drop(own)
    facts = keyed.agg(F.count(F.lit(1)).alias("rows"), F.count(own).alias("known")).first()
    rows, known = facts["rows"], facts["known"]
    if rows <= n:
        return df
    if known <= n:
        above, level, missing = keyed.where(F.col(own).isNotNull()), keyed.where(F.col(own).isNull()), n - known
    else:
        values = keyed.select(F.col(own).alias("x")).where(F.col("x").isNotNull())
        rank = known - n
        cut = values_at_ranks(values, known, [rank], bracket_limit)[rank]
        above, level = keyed.where(F.col(own) > cut), keyed.where(F.col(own) == cut)
        missing = n - above.count()
    return above.drop(own).unionByName(_first(level, ties, missing, bracket_limit).drop(own))


def _first(level: DataFrame, ties: Column, missing: int, bracket_limit: int) -> DataFrame:
    """The first ``missing`` rows by ``ties`` (null first), found by exact cut values and not in one task."""
    if missing <= 0:
        return level.limit(0)
    own = free_name(level, "_tie")
    tied = level.withColumn(own, ties)
    text = dict(tied.dtypes)[own] == "string"
    taken: DataFrame | None = None
    step = 0
    while True:
        if text:
            part = F.substring(F.col(own).cast("binary"), step * _TEXT_STEP + 1, _TEXT_STEP)
            number = F.conv(F.rpad(F.hex(part), 2 * _TEXT_STEP, "0"), 16, 10).cast("double")
        else:
            number = F.col(own).cast("double")
        spot = F.coalesce(number, F.lit(float("-inf")))
        rows = tied.count()
        if rows <= missing:
            found = tied
            break
        cut = values_at_ranks(tied.select(spot.alias("x")), rows, [missing - 1], bracket_limit)[missing - 1]
        under = tied.where(spot < cut)
        taken = under if taken is None else taken.unionByName(under)
        missing -= under.count()
        tied = tied.where(spot == cut)
        step += 1
        if not text or tied.where(F.octet_length(own) > step * _TEXT_STEP).isEmpty():
            # What is left is equal in key and tie: any of the rows will do.
            found = tied.limit(missing)
            break
    return (found if taken is None else taken.unionByName(found)).drop(own)


def newest(df: DataFrame, capacity: int, sequence: str) -> DataFrame:
    """What a buffer of ``capacity`` still holds: the rows with the highest sequence numbers."""
    return largest(df, capacity, F.col(sequence), F.col(sequence))


def uniform_sample(df: DataFrame, size: int, key: Column, seed: int) -> DataFrame:
    """min(size, rows) rows without replacement, the same ones on every run."""
    return largest(df, size, uniform(key, seed), key)


def prioritised_sample(
    df: DataFrame, size: int, priority: Column, key: Column, seed: int, alpha: float = 0.6
) -> DataFrame:
    """Without replacement, drawn in proportion to priority to the power ``alpha`` (Efraimidis and Spirakis keys)."""
    weight = F.pow(priority.cast("double"), F.lit(alpha))
    return largest(df.where(weight > 0), size, F.ln(uniform(key, seed)) / weight, key)
