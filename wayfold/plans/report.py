"""The tables that make up an evaluation report."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from wayfold.operators.metrics import confusion_counts, prediction_sample
from wayfold.plans.training import Outcome

SAMPLE_ROWS = 100
SHOWN_FEATURES = 20


def report_tables(outcome: Outcome, keys: list[str]) -> dict[str, DataFrame]:
    """Scores, ranking, importance, and confusion and sample of both in-sample and out-of-fold predictions."""
    proba = "proba" if "proba" in outcome.predictions.columns else None
    tables = {
        "summary": outcome.summary,
        "ranking": outcome.ranking,
        "importance": outcome.importance.orderBy("rank").limit(SHOWN_FEATURES),
        "sample_train": prediction_sample(outcome.predictions, keys, SAMPLE_ROWS, proba),
        "sample_out_of_fold": prediction_sample(outcome.out_of_fold, keys, SAMPLE_ROWS, proba),
    }
    if proba:
        tables["confusion_train"] = confusion_counts(outcome.predictions).orderBy("y", "y_pred")
        tables["confusion_out_of_fold"] = confusion_counts(outcome.out_of_fold).orderBy("y", "y_pred")
    return tables


def report_document(facts: dict, tables: dict[str, DataFrame]) -> str:
    """One JSON text. Every table in it is small by construction: a sample, or one row per class, feature or learner."""
    with ThreadPoolExecutor(4) as pool:
        rows = pool.map(lambda df: [r.asDict(recursive=True) for r in df.collect()], tables.values())
        return json.dumps({**facts, **dict(zip(tables, rows))}, sort_keys=True)


