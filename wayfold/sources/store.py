"""Datasets, experiments and models kept as Parquet tables under one folder.

Records are only ever appended, so concurrent writers cannot damage each other; the
newest row per id tells its present state.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.model import Dataset, text_columns
from wayfold.operators.profile import category_counts, full_profile
from wayfold.operators.sketches import SKETCHES, column_sketches, joint_profile, joint_quantiles

LAYERS = ("snapshots", "trajectories")
LAYER_ORDER = {"snapshots": ("ts",), "trajectories": ("eid", "step")}
DATASET_RECORD = (
    "id string, name string, version int, content_hash string, location string, source_type string, source_path string, "
    "layers array<string>, row_counts map<string,bigint>, column_counts map<string,int>, extras map<string,string>, "
    "registered_at string, deleted boolean"
)
EXPERIMENT_RECORD = (
    "experiment_id string, name string, experiment_type string, status string, updated_at string, created_at string, "
    "config string, metrics map<string,double>, result string, report string"
)
CATEGORY_RECORD = "name string, category string, rows bigint, layer string"
PREVIEW_ROWS = (1, 100)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def content_hash(df: DataFrame) -> str:
    """Fingerprint of the rows, whatever their order."""
    return count_and_hash(df)[1]


def _has_open_parts(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_open_parts(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_open_parts(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def canonical(value: Column, dtype: T.DataType) -> Column:
    """One form for equal values: maps as entries sorted by key, at any depth, and variants as their text. Other values stay as they are."""
    if not _has_open_parts(dtype):
        return value
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], dtype.valueType).alias("value")),
    )
    # A null map and an empty one differ.
    return F.struct(value.isNull().alias("missing"), F.sort_array(entries).alias("entries"))


def count_and_hash(df: DataFrame) -> tuple[int, str]:
    """Row count, and the digest of schema, count, hash sum and hash xor, from one aggregation."""
    row_hash = F.xxhash64(*[canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    parts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(row_hash).alias("mixed"),
    ).first()
    text = f"{df.schema.simpleString()}|{parts['n']}|{parts['total']}|{parts['mixed']}"
    return parts["n"], hashlib.sha256(text.encode()).hexdigest()


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records at ``path``; none only if there is no such path, so a broken table is an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def preview(df: DataFrame, rows: int, order: list[str]) -> tuple[DataFrame, int]:
    """The first ``rows`` (1 to 100) by ``order``, and the total row count."""
    least, most = PREVIEW_ROWS
    if not least <= rows <= most:
        raise ValueError(f"a preview has {least} to {most} rows")
    return df.orderBy(*order).limit(rows), df.count()


class DatasetStore:
    """Registered datasets: immutable layers, their profile, and a record each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def register(self, dataset: Dataset, name: str = "", exact: bool = True, sketches: bool = False) -> str:
        """Write the layers sorted and split by their order, then hash and profile what was written.

        ``exact=False`` takes distinct counts from sketches, which shuffles no values. Categories of text columns are stored
        beside the profile, one row each, however many there are. ``sketches=True`` stores what :meth:`joint_profile` and
        :meth:`joint_quantiles` merge.
        """
        location = f"{self.folder}/data-{uuid.uuid4().hex}"
        hashes: dict[str, str] = {}
        counts: dict[str, int] = {}
        layers = dataset.layers()
        for layer, df in layers.items():
            order = [c for c in LAYER_ORDER[layer] if c in df.columns]
            # Range partitions keep min/max of the order columns tight per file, so later filters skip files.
            laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
            laid_out.write.parquet(f"{location}/{layer}")
            # Everything below reads the written files, so a costly source is computed once.
            stored = self.spark.read.schema(df.schema).parquet(f"{location}/{layer}")
            counts[layer], hashes[layer] = count_and_hash(stored)
            profile = full_profile(stored, exact).withColumn("layer", F.lit(layer))
            profile.coalesce(1).write.mode("append").parquet(f"{location}/profile")
            if sketches:
                kept = column_sketches(stored).withColumn("layer", F.lit(layer))
                kept.coalesce(1).write.mode("append").parquet(f"{location}/sketches")
            if text_columns(stored):
                counted = category_counts(stored).withColumn("layer", F.lit(layer))
                counted.write.mode("append").parquet(f"{location}/categories")
        combined = hashlib.sha256(json.dumps(hashes, sort_keys=True).encode()).hexdigest()
        now = _now()
        dataset_id = hashlib.sha256(f"{name}{now}{combined}".encode()).hexdigest()[:12]
        extras = {k: v if isinstance(v, str) else json.dumps(v) for k, v in dataset.extras.items()}
        record = (
            dataset_id, name or dataset_id, 1, combined, location, dataset.source_type, dataset.source_path, list(layers),
            counts, {layer: len(df.columns) for layer, df in layers.items()}, extras, now, False,
        )
        _append(self.spark, f"{self.folder}/_records", DATASET_RECORD, record)
        return dataset_id

    def _all(self) -> DataFrame:
        return _records(self.spark, f"{self.folder}/_records", DATASET_RECORD)

    def datasets(self) -> DataFrame:
        """Records of the datasets that are still there, in order of registration."""
        gone = self._all().where("deleted").select("id")
        return self._all().where("not deleted").join(gone, "id", "left_anti").orderBy("registered_at")

    def exists(self, dataset_id: str) -> bool:
        return not self.datasets().where(F.col("id") == dataset_id).isEmpty()

    def _require(self, dataset_id: str) -> Row:
        record = self.datasets().where(F.col("id") == dataset_id).first()
        if record is None:
            raise KeyError(f"no dataset {dataset_id!r}")
        return record

    def layers(self, dataset_id: str) -> list[str]:
        return list(self._require(dataset_id)["layers"])

    def read(self, dataset_id: str, layer: str) -> DataFrame:
        """A registered layer; an unknown or missing one is an error."""
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}; known: {list(LAYERS)}")
        record = self._require(dataset_id)
        if layer not in record["layers"]:
            raise ValueError(f"dataset {dataset_id!r} has no {layer} layer")
        return self.spark.read.parquet(f"{record['location']}/{layer}")

    def profile(self, dataset_id: str, layer: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._require(dataset_id)['location']}/profile").where(F.col("layer") == layer)

    def categories(self, dataset_id: str, layer: str) -> DataFrame:
        """(name, category, rows) of the layer's text columns, all of them."""
        path = f"{self._require(dataset_id)['location']}/categories"
        return _records(self.spark, path, CATEGORY_RECORD).where(F.col("layer") == layer).drop("layer")

    def sketches(self, dataset_id: str, layer: str) -> DataFrame:
        """The layer's stored sketches, one row per column."""
        path = f"{self._require(dataset_id)['location']}/sketches"
        if not _exists(self.spark, path):
            raise ValueError(f"dataset {dataset_id!r} was registered without sketches")
        return self.spark.read.schema(f"{SKETCHES}, layer string").parquet(path).where(F.col("layer") == layer).drop("layer")

    def joint_profile(self, dataset_ids: list[str], layer: str) -> DataFrame:
        """The profile of several datasets' layers together, without reading their rows."""
        return joint_profile(reduce(DataFrame.unionByName, [self.sketches(i, layer) for i in dataset_ids]))

    def joint_quantiles(self, dataset_ids: list[str], layer: str, column: str, fractions: list[float], method: str = "nearest") -> list[float | None]:
        """Exact quantiles over several datasets' layers; of each, only rows near the wanted ranks are read."""
        return joint_quantiles([(self.read(i, layer), self.sketches(i, layer)) for i in dataset_ids], column, fractions, method)

    def delete(self, dataset_id: str) -> None:
        """Mark the record as deleted and remove the dataset's files."""
        location = self._require(dataset_id)["location"]
        row = (dataset_id,) + (None,) * 10 + (_now(), True)
        _append(self.spark, f"{self.folder}/_records", DATASET_RECORD, row)
        _remove(self.spark, location)


def latest(records: DataFrame, key: str, moment: str, carried: list[str]) -> DataFrame:
    """The newest row per key, where a column that a row leaves null keeps its earlier value."""
    return records.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(moment))).alias(c) for c in carried],
        F.max(moment).alias(moment),
    )


class ExperimentLog:
    """Experiments as appended state changes."""

    COLUMNS = ["name", "experiment_type", "status", "created_at", "config", "metrics", "result", "report"]

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.path = folder.rstrip("/") + "/_experiments"

    def _write(self, experiment_id: str, **values: object) -> None:
        row = (
            experiment_id, values.get("name"), values.get("experiment_type"), values.get("status"), _now(),
            values.get("created_at"), values.get("config"), values.get("metrics"), values.get("result"), values.get("report"),
        )
        _append(self.spark, self.path, EXPERIMENT_RECORD, row)

    def _rows(self, experiment_id: str) -> DataFrame:
        records = _records(self.spark, self.path, EXPERIMENT_RECORD)
        return records.where(F.col("experiment_id") == experiment_id)

    def _require(self, experiment_id: str) -> None:
        if self._rows(experiment_id).isEmpty():
            raise KeyError(f"no experiment {experiment_id!r}")

    def create(self, experiment_id: str, name: str, config: dict) -> None:
        if not self._rows(experiment_id).isEmpty():
            raise ValueError(f"experiment {experiment_id!r} exists already")
        kind = config.get("problem_type", "time_series")
        self._write(
            experiment_id, name=name, experiment_type=kind, status="pending", created_at=_now(),
            config=json.dumps(config, sort_keys=True),
        )

    def set_status(self, experiment_id: str, status: str) -> None:
        self._require(experiment_id)
        self._write(experiment_id, status=status)

    def save_result(self, experiment_id: str, status: str, metrics: dict | None = None, result: dict | None = None, report: dict | None = None) -> None:
        self._require(experiment_id)
        self._write(
            experiment_id, status=status, metrics=metrics,
            result=None if result is None else json.dumps(result), report=None if report is None else json.dumps(report),
        )

    def experiments(self, kind: str | None = None) -> DataFrame:
        """Present state of every experiment, newest first."""
        records = _records(self.spark, self.path, EXPERIMENT_RECORD)
        state = latest(records, "experiment_id", "updated_at", self.COLUMNS)
        if kind is not None:
            state = state.where(F.col("experiment_type") == kind)
        return state.orderBy(F.desc("created_at"))

    def get(self, experiment_id: str) -> dict:
        self._require(experiment_id)
        return latest(self._rows(experiment_id), "experiment_id", "updated_at", self.COLUMNS).first().asDict()
