"""Ordered windows whose tasks stay small however long one key's run is.

A window with no key plans as one task, and a window over a hot key puts that
key's whole run in one task. Both are avoided in the same way:

1. boundaries over the leading order column (approximate percentiles, so a crowded
   stretch gets more of them) split every run into blocks; a value that fills whole blocks by itself gets a block of its
   own, which boundaries over the next order column split;
2. rows per (key, block) are counted, map-side first, and summed up to offsets, which
   turns a block-local row number into the row's exact position within its key;
3. positions are cut into slabs of equal size, the rows a frame needs from the
   neighbouring slab are copied over its edge, and the window runs per (key, slab).

All of it depends on values only, never on partition ids, so a lost executor's
work can be redone at any time. Where no key's run is longer than a block, the plain
window is used: hash partitions of many short runs are even by themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.names import free_name

ROWS_PER_BLOCK = 1_000_000
MAX_BOUNDARIES = 10_000

_BLOCK, _POSITION, _SLAB, _COPY, _WEIGHT, _CARRY = "_block", "_position", "_slab", "_copy", "_weight", "_carry"


def never_null(key: Column) -> Column:
    """The key as a text that is never null and differs between different keys, so that null joins null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def boundaries(df: DataFrame, column: str, rows: int, rows_per_block: int) -> list[float]:
    """Increasing cut points with about ``rows_per_block`` rows between them; a crowded value comes several times."""
    wanted = min(MAX_BOUNDARIES, math.ceil(rows / rows_per_block))
    if wanted < 2:
        return []
    fractions = [i / wanted for i in range(1, wanted)]
    accuracy = max(10_000, 20 * wanted)
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), fractions, accuracy).alias("cuts")).first()["cuts"]
    return sorted(cuts or [])


def in_number_order(df: DataFrame, column: str) -> Column:
    """A number that never falls as the column rises: itself, or the first six bytes of a text."""
    if dict(df.dtypes)[column] != "string":
        return F.col(column).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def blocked(df: DataFrame, order: list[str], rows: int, rows_per_block: int) -> DataFrame | None:
    """``df`` with a block number that grows with the order, or None if one block holds everything."""
    found = boundaries(df, order[0], rows, rows_per_block)
    cuts = sorted(set(found))
    # Whole numbers beyond 2^53 are not told apart as doubles.
    crowded = [c for c in cuts if found.count(c) > 1 and abs(c) < 2**53] if len(order) > 1 and len(cuts) < len(found) else []
    cuts = sorted({*cuts, *(math.nextafter(c, math.inf) for c in crowded)})
    if not cuts:
        return None
    placed = with_block(df, order[0], cuts)
    if not crowded:
        return placed
    # The crowded values' own blocks hold one leading value each, so the next column decides the order inside.
    lead, follow = F.col(order[0]).cast("double"), in_number_order(df, order[1])
    share = {c: found.count(c) + 1 for c in crowded}
    most = max(share.values())
    fractions = [i / most for i in range(1, most)]
    inner = (
        df.where(lead.isin(crowded)).groupBy(lead.alias("lead"))
        .agg(F.percentile_approx(follow, fractions, max(10_000, 20 * most)).alias("cuts")).collect()
    )
    below = F.lit(0)
    for row in inner:
        found_below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(row["cuts"]))]), lambda c: c < follow))
        below = F.when(lead == row["lead"], found_below).otherwise(below)
    return placed.withColumn(_BLOCK, F.col(_BLOCK).cast("bigint") * (most + 1) + F.coalesce(below, F.lit(0)))


def with_block(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """Add the block number of every row; the binary search runs inside the JVM."""
    if not cuts:
        return df.withColumn(_BLOCK, F.lit(0))
    keyed = df.withColumn("_cut_key", F.col(column).cast("double"))
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_cut_key", outputCol=_BLOCK, handleInvalid="keep"
    )
    return bucketizer.transform(keyed).withColumn(_BLOCK, F.col(_BLOCK).cast("int")).drop("_cut_key")


def positions_by_block(df: DataFrame, keys: list[str], order: list[Column], block: str, out: str) -> DataFrame:
    """Exact 0-based position of each row within its key, from block-local counting plus offsets.

    ``block`` must grow with the order. One block's rows per key meet in a task, never a key's whole run.
    The offset of a block travels as one extra row in front of the block's own rows, so the rows
    are shuffled once and nothing is joined.
    """
    weight, carry, rows_of = (free_name(df, n) for n in (_WEIGHT, _CARRY, "_rows"))
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias(rows_of))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, block, F.coalesce(F.sum(rows_of).over(earlier), F.lit(0)).alias(weight), F.lit(True).alias(carry)
    )
    rows = df.select("*", F.lit(1).cast("bigint").alias(weight), F.lit(False).alias(carry))
    up_to_here = (
        Window.partitionBy(*keys, block).orderBy(F.desc(carry), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.unionByName(offsets, allowMissingColumns=True).withColumn(out, F.sum(weight).over(up_to_here) - 1)
    return placed.filter(~F.col(carry)).drop(weight, carry)


@dataclass(frozen=True)
class OrderedRows:
    """Rows prepared for ordered windows; ask :attr:`window` for the spec and :meth:`finish` at the end.

    In split rows ``keys`` are helper columns that are never null.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @property
    def window(self) -> WindowSpec:
        if self.split:
            return Window.partitionBy(*self.keys, _SLAB).orderBy(_POSITION)
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        """All rows that a window sees at once, in no order."""
        return Window.partitionBy(*self.keys, _SLAB) if self.split else Window.partitionBy(*self.keys)

    def numbered(self, out: str) -> "OrderedRows":
        """The 1-based position within the key: known already where rows were split."""
        return self.select((F.col(_POSITION) + 1 if self.split else F.row_number().over(self.window).cast("bigint")).alias(out))

    def select(self, *columns: Column | str) -> "OrderedRows":
        """Add columns (usually over :attr:`window`) in one projection."""
        return OrderedRows(self.frame.select("*", *columns), self.keys, self.order, self.split)

    def running_sums(self, sums: dict[str, Column]) -> "OrderedRows":
        """Inclusive running totals per key; null counts as zero."""
        up_to_here = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            totals = [F.sum(F.coalesce(c, F.lit(0))).over(up_to_here).alias(n) for n, c in sums.items()]
            return self.select(*totals)
        values = self.frame.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()])
        partial = values.filter(~F.col(_COPY)).groupBy(*self.keys, _SLAB).agg(
            *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums]
        )
        earlier = Window.partitionBy(*self.keys).orderBy(_SLAB).rowsBetween(Window.unboundedPreceding, -1)
        carried = partial.select(
            *self.keys, _SLAB, *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
        )
        # Windows have left the rows partitioned by (key, slab), which this join reuses.
        joined = values.join(carried, [*self.keys, _SLAB])
        own = [
            (F.col(f"_c_{n}") + F.coalesce(F.sum(F.when(~F.col(_COPY), F.col(f"_v_{n}"))).over(up_to_here), F.lit(0)))
            .alias(n)
            for n in sums
        ]
        helpers = [f"_{p}_{n}" for n in sums for p in "vc"]
        return OrderedRows(joined.select("*", *own).drop(*helpers), self.keys, self.order, True)

    def finish(self) -> DataFrame:
        """Drop the copied edge rows and the helper columns."""
        if not self.split:
            return self.frame
        return self.frame.filter(~F.col(_COPY)).drop(*self.keys, _BLOCK, _POSITION, _SLAB, _COPY)


def ordered_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int = 0,
    after: int = 0,
    rows_per_block: int = ROWS_PER_BLOCK,
    rows: int | None = None,
    split: bool | None = None,
) -> OrderedRows:
    """Prepare ``df`` for windows over ``keys`` ordered by ``order``.

    ``order`` must be unique within a key and lead with a number. ``before`` and
    ``after`` say how many neighbouring rows the widest frame touches. Runs are split
    when the longest one exceeds ``rows_per_block``, or as ``split`` says.
    """
    total = df.count() if rows is None else rows
    if split is None:
        split = total > rows_per_block and longest_run(df, keys, total) > rows_per_block
    helpers = {f"_key{i}": never_null(F.col(k)) for i, k in enumerate(keys)}
    cut = blocked(df.withColumns(helpers), order, total, rows_per_block) if split else None
    if cut is None:
        return OrderedRows(df, tuple(keys), tuple(order), False)
    placed = positions_by_block(cut, list(helpers), [F.col(c) for c in order], _BLOCK, _POSITION)
    size = max(rows_per_block, before, after)
    return OrderedRows(with_edges(placed, size, before, after), tuple(helpers), tuple(order), True)


def longest_run(df: DataFrame, keys: list[str], rows: int) -> int:
    """Rows of the largest key, from one count that is combined map-side."""
    if not keys:
        return rows
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def with_edges(placed: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Cut positions into slabs and copy the rows next to an edge into the neighbouring slab."""
    slab = F.floor(F.col(_POSITION) / size)
    place = F.col(_POSITION) % size
    homes = [F.struct(slab.alias("slab"), F.lit(False).alias("copy"))]
    if before:
        homes.append(F.when(place >= size - before, F.struct((slab + 1).alias("slab"), F.lit(True).alias("copy"))))
    if after:
        homes.append(
            F.when((place < after) & (slab > 0), F.struct((slab - 1).alias("slab"), F.lit(True).alias("copy")))
        )
    exploded = placed.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_home"))
    return exploded.select(
        *placed.columns, F.col("_home.slab").alias(_SLAB), F.col("_home.copy").alias(_COPY)
    )
