"""Records whose fields vary by row: ``MAP`` and ``VARIANT`` columns turned into plain columns.

The names are found by one aggregation that is combined map-side and whose result has a row for each name, however many rows
there are; for variants the same aggregation tells a type that holds all values of a name. The rows then see one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table with more columns than this is of no use; records with so many field names have their data in the names.
MAX_NAMES = 10_000
_VARIANT_MAP = T.MapType(T.StringType(), T.VariantType())


def is_open(dtype: T.DataType) -> bool:
    """True for a type whose field names are only known from the rows."""
    return isinstance(dtype, T.VariantType) or (isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType))


def _values_vary(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType) or isinstance(dtype.valueType, T.VariantType)


def as_map(column: str, dtype: T.DataType) -> Column:
    """The fields as a map; a variant that is no object has none."""
    return F.col(f"`{column}`").try_cast(_VARIANT_MAP) if isinstance(dtype, T.VariantType) else F.col(f"`{column}`")


def plain_type(told: str) -> str:
    """The column type for what Spark tells of a name's variant values."""
    base = told.split("(")[0].split("<")[0].strip().lower()
    if base in ("bigint", "boolean", "string", "date", "timestamp", "timestamp_ntz", "binary"):
        return base
    if base in ("decimal", "double", "float"):
        return "double"
    return "variant" if base == "object" else "string"


def found_fields(raw: DataFrame, columns: list[str]) -> dict[str, dict[str, str | None]]:
    """For each open column its field names, sorted, with their types (None where the map's own type holds)."""
    entries = []
    for c in columns:
        dtype = raw.schema[c].dataType
        entries.append(_entries(F.lit(c), as_map(c, dtype), _values_vary(dtype)))
    held = F.flatten(F.array_compact(F.array(*entries)))
    rows = (
        raw.select(F.inline(held)).groupBy("parent", "name").agg(F.schema_of_variant_agg("value").alias("told"))
        .limit(MAX_NAMES + 1).collect()
    )
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names in {columns}")
    found: dict[str, dict[str, str | None]] = {c: {} for c in columns}
    for row in sorted(rows, key=lambda r: (r["parent"], r["name"])):
        found[row["parent"]][row["name"]] = plain_type(row["told"]) if _values_vary(raw.schema[row["parent"]].dataType) else None
    return found


def _entries(parent: Column, fields: Column, varies: bool) -> Column:
    nothing = F.lit(None).cast("variant")
    return F.transform(
        F.map_entries(fields), lambda e: F.struct(parent.alias("parent"), e["key"].alias("name"), (e["value"] if varies else nothing).alias("value"))
    )


def field(fields: Column, name: str, dtype: str | None) -> Column:
    """One field of a map; null where a row does not have it or its value is not of the type."""
    value = F.try_element_at(fields, F.lit(name))
    return value if dtype in (None, "variant") else F.try_variant_get(value, "$", dtype)


def open_projection(raw: DataFrame, renames: dict[str, Callable[[str], str | None]]) -> list[tuple[str, str, str, str | None]]:
    """(parent, field, column name, type) of every known field of the open columns among ``renames``."""
    parents = [p for p in renames if p in raw.columns and is_open(raw.schema[p].dataType)]
    if not parents:
        return []
    found = found_fields(raw, parents)
    return [(p, n, new, dtype) for p in parents for n, dtype in found[p].items() if (new := renames[p](n))]


def spread(records: DataFrame, column: str, nested: tuple[str, ...] = ()) -> DataFrame | None:
    """A column for each field of the records in an open column, or None if they have no fields.

    Objects stay variants, and so do all values of the fields named as ``nested``.
    """
    found = found_fields(records, [column])[column]
    if not found:
        return None
    fields = records.select(as_map(column, records.schema[column].dataType).alias("fields"))
    return fields.select(*[field(F.col("fields"), n, None if n in nested else dtype).alias(n) for n, dtype in found.items()])
