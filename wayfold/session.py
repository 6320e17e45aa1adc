"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths that this process has named under the shared folder and not removed yet.
_made: list[str] = []


def local_session(cores: int | str = "*", app: str = "wayfold", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wayfold-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def scratch_mark() -> int:
    """A point to which :func:`remove_scratch` goes back."""
    return len(_made)


def remove_scratch(spark: SparkSession, since: int = 0) -> int:
    """Remove what was written to the shared folder since a mark; tables that still read from it must have been saved elsewhere."""
    gone = _made[since:]
    del _made[since:]
    for path in gone:
        _delete(spark, path)
    return len(gone)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives the loss of executors, and reading it again prunes
    columns, which a checkpointed RDD would not.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_lived_path(spark: SparkSession, label: str) -> Iterator[str]:
    """A new path under the shared folder that is removed at the end."""
    path = fresh_path(spark, label)
    try:
        yield path
    finally:
        if path in _made:
            _made.remove(path)
        _delete(spark, path)


@contextmanager
def short_lived(df: DataFrame, label: str = "table") -> Iterator[DataFrame]:
    """As :func:`cut_lineage`, for a table that is read inside only: it is removed at the end."""
    with short_lived_path(df.sparkSession, label) as path:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(FREE_SETTING)
    spark.conf.set(FREE_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SETTING, before)
