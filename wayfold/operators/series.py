"""Lag, rolling, trend and lead columns over an ordered series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.time import epoch_seconds
from wayfold.model import require_columns
from wayfold.operators.blocks import OrderedRows, ordered_rows


@dataclass(frozen=True)
class Interval:
    """Spacing of a series: the first gap, and how many gaps differ from it."""

    seconds: float
    rows: int
    irregular: int

    @property
    def regular(self) -> bool:
        return self.irregular == 0


def bucket_interval(df: DataFrame, ts: str = "ts", series: list[str] | None = None, on_gap: str = "warn") -> Interval:
    """First gap of the series in seconds (of all series: the smallest first gap), and the number of gaps that differ."""
    require_columns(df, ts)
    keys = series or []
    values = df.select(epoch_seconds(df, ts).alias("t"), *keys).where(F.col("t").isNotNull())
    if keys:
        # Spark keeps the first two rows per series already before the shuffle, so a hot series stays small.
        first = values.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).filter("_k <= 2")
        gaps = first.groupBy(*keys).agg((F.max("t") - F.min("t")).alias("gap"), F.count(F.lit(1)).alias("n"))
        gap = gaps.filter("n = 2 and gap > 0").agg(F.min("gap").alias("gap")).first()["gap"]
        if gap is None:
            raise ValueError("at least two rows per series are needed")
    else:
        head = [r["t"] for r in values.orderBy("t").limit(2).collect()]
        if len(head) < 2:
            raise ValueError("at least two rows are needed to tell the interval")
        gap = head[1] - head[0]
        if gap <= 0:
            raise ValueError("times must increase from row to row")
    rows = values.count()
    ready = ordered_rows(values, keys, ["t"], before=1, rows=rows)
    followed = ready.select((F.col("t") - F.lag("t").over(ready.window)).alias("gap")).finish()
    irregular = followed.agg(F.count_if(F.abs(F.col("gap") - F.lit(float(gap))) > 1e-6 * gap).alias("n")).first()["n"]
    if irregular and on_gap == "error":
        raise ValueError(f"the series is irregular: {irregular} gaps differ from the first")
    return Interval(float(gap), rows, int(irregular))


def lag(column: str, w: WindowSpec, k: int) -> Column:
    return F.lag(column, k).over(w)


def finite(column: str) -> Column:
    """True for a value that is neither null, infinite nor not a number."""
    return F.coalesce(F.abs(F.col(column).cast("double")) < F.lit(float("inf")), F.lit(False))


# From frames of so many rows on, rolling statistics are differences of running sums.
LONG_FRAME = 32


def with_running_sums(rows: OrderedRows, frames: dict[str, int]) -> OrderedRows:
    """Adds what long frames need: per column running counts, of values and of those that are not finite, and sums of x, x^2 and i x.

    A moving frame looks at all its rows again for each row, so its cost is rows x frame; a difference of two running
    sums costs the same for any frame. Values are centred on the mean of the rows a window sees, which keeps the differences exact
    to rounding; values that are not finite are counted and left out of the sums. Rows are numbered from the first that a window sees, so that
    the sums stay small however far down a run it lies. ``frames`` gives the longest frame of each column; short ones need nothing.
    """
    long = [c for c, k in frames.items() if k >= LONG_FRAME]
    if not long:
        return rows
    centred = rows.select(
        (F.col("_row") - F.min("_row").over(rows.whole)).alias("_near"),
        *[F.coalesce(F.avg(F.when(finite(c), F.col(c).cast("double"))).over(rows.whole), F.lit(0.0)).alias(f"_mid_{c}") for c in long],
    )
    running = rows.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = []
    for c in long:
        x = F.when(finite(c), F.col(c).cast("double") - F.col(f"_mid_{c}"))
        sums.append(F.count(c).over(running).alias(f"_count_{c}"))
        sums.append(F.count_if(F.col(c).isNotNull() & ~finite(c)).over(running).alias(f"_odd_{c}"))
        for name, term in (("sum", x), ("square", x * x), ("moment", x * F.col("_near"))):
            sums.append(F.coalesce(F.sum(term).over(running), F.lit(0.0)).alias(f"_{name}_{c}"))
    return centred.select(*sums)


def running_helpers(frames: dict[str, int]) -> list[str]:
    return ["_near", *[f"_{n}_{c}" for c, k in frames.items() if k >= LONG_FRAME for n in ("mid", "count", "odd", "sum", "square", "moment")]]


def _over_frame(name: str, column: str, w: WindowSpec, k: int) -> Column:
    total = F.col(f"_{name}_{column}")
    return total - F.coalesce(F.lag(total, k).over(w), F.lit(0))


def _full(value: Column, column: str, w: WindowSpec, k: int) -> Column:
    """``value`` where the frame is full; not a number where it holds a value that is not finite."""
    if k >= LONG_FRAME:
        n, odd = _over_frame("count", column, w, k), _over_frame("odd", column, w, k) > 0
    else:
        n, odd = F.count(column).over(w.rowsBetween(1 - k, 0)), F.abs(value) == F.lit(float("inf"))
    return F.when(n == k, F.when(odd, F.lit(float("nan"))).otherwise(value))


def rolling_mean(column: str, w: WindowSpec, k: int) -> Column:
    """Mean of the last ``k`` rows, null until there are ``k`` values; long frames need :func:`with_running_sums`."""
    if k >= LONG_FRAME:
        return _full(_over_frame("sum", column, w, k) / k + F.col(f"_mid_{column}"), column, w, k)
    return _full(F.avg(column).over(w.rowsBetween(1 - k, 0)), column, w, k)


def rolling_std(column: str, w: WindowSpec, k: int) -> Column:
    """Sample standard deviation of the last ``k`` rows, null until there are ``k`` values."""
    if k >= LONG_FRAME:
        total = _over_frame("sum", column, w, k)
        squares = _over_frame("square", column, w, k) - total * total / k
        return _full(F.sqrt(F.greatest(squares, F.lit(0.0)) / (k - 1)), column, w, k)
    return _full(F.stddev_samp(column).over(w.rowsBetween(1 - k, 0)), column, w, k)


def trend(column: str, w: WindowSpec, k: int) -> Column:
    """Least-squares slope per step over the last ``k`` rows, null until there are ``k`` values.

    ``_row`` numbers the rows of the window and ``_near`` those that one task sees; only differences matter.
    """
    if k < 2:
        return F.lit(None).cast("double")
    if k >= LONG_FRAME:
        middle = F.col("_near") - (k - 1) / 2
        slope = (_over_frame("moment", column, w, k) - middle * _over_frame("sum", column, w, k)) / (k * (k * k - 1) / 12)
        return _full(slope, column, w, k)
    return _full(F.regr_slope(F.col(column).cast("double"), F.col("_row")).over(w.rowsBetween(1 - k, 0)), column, w, k)


def target_ahead(column: str, w: WindowSpec, k: int) -> Column:
    return F.lead(column, k).over(w)
