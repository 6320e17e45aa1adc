"""CSV, Parquet and layered JSON files as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.model import Dataset, is_temporal
from wayfold.sources.layered_json import load_layered_json

# Column names that mark a table as a time series.
TIME_NAMES = (
    "ts", "timestamp", "time", "date", "datetime", "t", "period", "bucket_idx", "bucket_index", "time_step", "timestep",
)


def is_series(df: DataFrame) -> bool:
    """True if a column is named or typed like a time."""
    return any(f.name.lower().strip() in TIME_NAMES or is_temporal(f.dataType) for f in df.schema.fields)


def layer_of(df: DataFrame) -> str:
    return "snapshots" if is_series(df) else "trajectories"


def _dataset(df: DataFrame, kind: str, path: str, mapping: dict[str, str] | None) -> Dataset:
    renamed = df.withColumnsRenamed(mapping) if mapping else df
    if renamed.isEmpty():
        raise ValueError(f"{kind} input has no rows: {path}")
    return Dataset(**{layer_of(renamed): renamed}, source_type=kind, source_path=path)


def load_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, **options: object) -> Dataset:
    """Read CSV with a header. Give ``schema=`` on large inputs: inferring types reads everything once more."""
    schema = options.pop("schema", None)
    settings = {"header": True, "inferSchema": schema is None, **options}
    return _dataset(spark.read.csv(path, schema=schema, **settings), "csv", path, mapping)


def load_parquet(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> Dataset:
    return _dataset(spark.read.parquet(path), "parquet", path, mapping)


def load(spark: SparkSession, path: str, **options: object) -> Dataset:
    """Choose the reader by suffix: ``.json``, ``.parquet``, anything else is CSV."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".json"):
        return load_layered_json(spark, path, **options)
    if lowered.endswith(".parquet"):
        return load_parquet(spark, path, **options)
    return load_csv(spark, path, **options)
