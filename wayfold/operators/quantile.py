"""Exact order statistics without a global sort.

Approximate percentiles bracket the wanted rank, the bracket is counted, and only
the values inside it are looked at; the counts prove that the answer is the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut_lineage

# Values that one task may collect and sort.
BRACKET_LIMIT = 100_000


def quantiles(
    df: DataFrame,
    column: str,
    fractions: list[float],
    method: str = "nearest",
    bracket_limit: int = BRACKET_LIMIT,
) -> list[float | None]:
    """Quantiles of the non-null values: ``nearest`` takes a real value, ``linear`` interpolates."""
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown quantile method: {method}")
    values = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    n = values.count()
    if n == 0:
        return [None] * len(fractions)
    if n > bracket_limit:
        # Several passes follow; the one column they need is computed and written once.
        values = cut_lineage(values, "values")
    spots = spots_of(n, fractions, method)
    ranks = sorted({int(r) for s in spots for r in (math.floor(s), math.ceil(s))})
    return at_spots(values_at_ranks(values, n, ranks, bracket_limit), spots)


def spots_of(n: int, fractions: list[float], method: str) -> list[float]:
    """0-based positions of the quantiles in ``n`` sorted values; whole numbers for ``nearest``."""
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown quantile method: {method}")
    spots = [q * (n - 1) for q in fractions]
    return [float(math.floor(s + 0.5)) for s in spots] if method == "nearest" else spots


def at_spots(found: dict[int, float], spots: list[float]) -> list[float]:
    """Values at positions, between two ranks by interpolation."""
    out = []
    for s in spots:
        low, high = found[math.floor(s)], found[math.ceil(s)]
        out.append(low if low == high else low + (high - low) * (s - math.floor(s)))
    return out


def values_at_ranks(values: DataFrame, n: int, ranks: list[int], bracket_limit: int) -> dict[int, float]:
    """The value at each 0-based rank of the single column ``x``; all ranks share the passes.

    A round looks at the values that the round before left, which are some thousandth of its own for each rank.
    """
    answers: dict[int, float] = {}
    # Per round: the values, their number, the ranks within them by the rank asked, and how exact the sketch has to be.
    left = [(values, n, {r: r for r in ranks}, 10_000)]
    while left:
        rows, size, wanted, accuracy = left.pop()
        if size <= bracket_limit:
            found = _ranked(rows, 0, sorted(set(wanted.values())))
            answers |= {rank: found[own] for rank, own in wanted.items()}
            continue
        known, inside, missed = _brackets(rows, size, wanted, accuracy)
        answers |= known
        if missed:  # the sketch missed; a finer one cannot miss by as much
            left.append((rows, size, missed, accuracy * 4))
        few = {rank: b for rank, b in inside.items() if b.rows <= bracket_limit}
        if few:
            # The values of one bracket are what one task sorts.
            ordered = [
                F.element_at(F.sort_array(F.collect_list(F.when(b.holds(), F.col("x")))), F.lit(b.place + 1)).alias(f"r{rank}") for rank, b in few.items()
            ]
            row = rows.where(any_of(b.holds() for b in few.values())).agg(*ordered).first()
            answers |= {rank: row[f"r{rank}"] for rank in few}
        many = {rank: b for rank, b in inside.items() if rank not in few}
        if many:
            left.append((*kept_inside(rows, many, bracket_limit), 10_000))
    return answers


@dataclass(frozen=True)
class Bracket:
    """Values between two bounds (None: no bound), which may be ``open``; the wanted one is at ``place`` of the ``rows`` in between."""

    low: float | None
    high: float | None
    place: int
    rows: int
    open: bool = True

    def holds(self) -> Column:
        x = F.col("x")
        above = F.lit(True) if self.low is None else x > self.low if self.open else x >= self.low
        return above if self.high is None else above & (x < self.high if self.open else x <= self.high)

    def under(self) -> Column:
        """Is a value below all of them?"""
        if self.low is None:
            return F.lit(False)
        return F.col("x") <= self.low if self.open else F.col("x") < self.low


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def kept_inside(values: DataFrame, brackets: dict[int, Bracket], bracket_limit: int) -> tuple[DataFrame, int, dict[int, int]]:
    """The values inside any of the brackets, their number and each bracket's place among them; many are written once, as passes follow."""
    kept = values.where(any_of(b.holds() for b in brackets.values()))
    if sum(b.rows for b in brackets.values()) > bracket_limit:
        kept = cut_lineage(kept, "inside")
    row = kept.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b.under()).alias(f"r{rank}") for rank, b in brackets.items()]).first()
    return kept, row["n"], {rank: row[f"r{rank}"] + b.place for rank, b in brackets.items()}


def _brackets(
    values: DataFrame, n: int, wanted: dict[int, int], accuracy: int,
) -> tuple[dict[int, float], dict[int, Bracket], dict[int, int]]:
    """Answers, brackets of the others and ranks that the sketch missed, in two passes: the bounds by a sketch, counts that prove them."""
    slack = 3.0 / accuracy
    edges = [min(1.0, max(0.0, own / max(n - 1, 1) + d)) for own in wanted.values() for d in (-slack, slack)]
    row = values.agg(F.percentile_approx("x", edges, accuracy).alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    bounds = [row["lo"] if e == 0.0 else row["hi"] if e == 1.0 else b for e, b in zip(edges, row["b"], strict=True)]
    x = F.col("x")
    counts = values.agg(*[c for b in bounds for c in (F.count_if(x < b), F.count_if(x <= b))]).first()
    answers, inside, missed = {}, {}, {}
    for i, (rank, own) in enumerate(wanted.items()):
        low, high = bounds[2 * i : 2 * i + 2]
        under_low, upto_low, under_high, upto_high = counts[4 * i : 4 * i + 4]
        if under_low <= own < upto_low:
            answers[rank] = low
        elif under_high <= own < upto_high:
            answers[rank] = high
        elif upto_low <= own < under_high:
            inside[rank] = Bracket(low, high, own - upto_low, under_high - upto_low)
        else:
            missed[rank] = own
    return answers, inside, missed


def _ranked(values: DataFrame, below: int, ranks: list[int]) -> dict[int, float]:
    """Values by rank of at most ``bracket_limit`` rows; only the values asked for leave the task."""
    ordered = values.agg(F.sort_array(F.collect_list("x")).alias("xs"))
    row = ordered.select(*[F.element_at("xs", F.lit(r - below + 1)).alias(f"r{r}") for r in ranks]).first()
    return {r: row[f"r{r}"] for r in ranks}
