"""Labels as class numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.model import MAX_CLASSES, is_numeric, is_text
from wayfold.operators.classes import attach, class_table

# More classes than this stay a table; a model that names its classes is not fitted on them.
LISTED_CLASSES = 10_000


@dataclass(frozen=True)
class Encoding:
    """How a target becomes a number: ``classes`` in order, or none for a regression.

    ``rows`` is the number of labelled rows where counting the classes has told it. Beyond LISTED_CLASSES ``classes`` is none and
    ``table`` has (class, number, rows).
    """

    task: str
    classes: tuple | None = None
    rows: int | None = None
    table: DataFrame | None = None

    @property
    def names(self) -> list[str] | None:
        if self.classes is None:
            return None
        return [c if isinstance(c, str) else (str(int(c)) if float(c) == int(c) else str(c)) for c in self.classes]

    def add(self, df: DataFrame, target: str, out: str) -> DataFrame:
        """``df`` with the target's number in ``out``."""
        if self.table is None:
            return df.withColumn(out, self.column(target))
        return attach(df, target, self.table, {out: "number"}).withColumn(out, F.col(out).cast("int"))

    def column(self, target: str) -> Column:
        if self.table is not None:
            raise ValueError(f"more than {LISTED_CLASSES} classes are no expression; use add()")
        if self.classes is None:
            return F.col(target).cast("double")
        pairs = [part for i, c in enumerate(self.classes) for part in (F.lit(c), F.lit(i))]
        return F.create_map(*pairs)[F.col(target)].cast("int")


def encoding_of(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> Encoding:
    """Text becomes sorted classes, however many; a number with few values too, any other number a regression target."""
    dtype = df.schema[target].dataType
    if not (is_text(dtype) or is_numeric(dtype)):
        raise ValueError(f"target {target!r} has type {dtype.simpleString()}, which cannot be encoded")
    grouped = df.where(F.col(target).isNotNull()).groupBy(target).count()
    # One value more than allowed tells that a number is no class, or that a text's classes, as many as there are, stay a table.
    most = LISTED_CLASSES if is_text(dtype) else max_classes
    seen = grouped.limit(most + 1).collect()
    if len(seen) <= most:
        return Encoding("classification", tuple(sorted(row[0] for row in seen)), sum(row[1] for row in seen))
    if is_text(dtype):
        classes = class_table(df, target)
        return Encoding("classification", None, classes.agg(F.sum("rows")).first()[0], classes)
    return Encoding("regression")
