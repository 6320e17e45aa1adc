"""Saved models with a record each."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.training import FittedModel, pipeline
from wayfold.sources.store import _append, _records, _remove

MODEL_RECORD = (
    "id string, experiment_id string, learner string, task string, features array<string>, classes array<string>, "
    "metrics map<string,double>, settings string, created_at string, deleted boolean"
)


class ModelStore:
    """Models under one folder: the pipeline itself and an appended record."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.records = f"{self.folder}/_models"

    def save(self, model_id: str, fitted: FittedModel, experiment_id: str = "", metrics: dict | None = None) -> str:
        pipeline(fitted).write().save(f"{self.folder}/{model_id}")
        now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        row = (
            model_id, experiment_id, fitted.learner, fitted.task, list(fitted.features),
            list(fitted.classes) if fitted.classes else None, metrics or {}, json.dumps(fitted.settings), now, False,
        )
        _append(self.spark, self.records, MODEL_RECORD, row)
        return model_id

    def models(self) -> DataFrame:
        """Records of the models that are still there, newest first."""
        known = _records(self.spark, self.records, MODEL_RECORD)
        gone = known.where("deleted").select("id")
        return known.where("not deleted").join(gone, "id", "left_anti").orderBy(F.desc("created_at"))

    def load(self, model_id: str) -> FittedModel:
        record = self.models().where(F.col("id") == model_id).first()
        if record is None:
            raise KeyError(f"no model {model_id!r}")
        stages = PipelineModel.load(f"{self.folder}/{model_id}").stages
        classes = tuple(record["classes"]) if record["classes"] else None
        return FittedModel(
            stages[-1], record["learner"], record["task"], tuple(record["features"]), classes, json.loads(record["settings"])
        )

    def delete(self, model_id: str) -> None:
        if self.models().where(F.col("id") == model_id).isEmpty():
            raise KeyError(f"no model {model_id!r}")
        now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        _append(self.spark, self.records, MODEL_RECORD, (model_id,) + (None,) * 7 + (now, True))
        _remove(self.spark, f"{self.folder}/{model_id}")
