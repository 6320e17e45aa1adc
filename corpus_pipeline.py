"""A corpus pipeline: five stages over ``documents``, each calling one operator of ``wayfold.llm``.

Each stage works on all that the stage before it kept; the stages that filter give whole rows of ``documents``, and the last gives the
pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from wayfold.llm.common import crc_fold, documents
from wayfold.llm.queries import vocabulary
from wayfold.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the ranking learned from the labelled training rows scores at 0.5 or more stay."""
    train = crc_fold("doc_id", 3) != 1
    ranking = quality.fit(docs, documents(spark, folder, "labels").where(train), train)
    return quality.accepted(docs, ranking)


def drop_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, documents(spark, folder, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    # Executors have grown in the stages before, so workers hold fewer pre-tokens than they do when packing is all there is.
    return packing.pack(docs, vocabulary(), with_ids=False, held_ids=500_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_repeats),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_windows),
]
# No SQL: the first stage applies a fitted model and the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
