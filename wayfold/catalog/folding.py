"""Folds, weights and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import SNAPSHOTS, Entry, split_block
from wayfold.functions.hashing import named_seed_column
from wayfold.operators.folds import balanced_weights, positive_weight, shuffled_folds, temporal_folds
from wayfold.sources.event_tables import snapshots, table


def temporal(spark, folder):
    sn = snapshots(spark, folder).select("ts", "arrivals")
    made = temporal_folds(sn, 5, ["ts"], split_block(sn.count()))
    return made.withColumn("fold", F.col("fold").cast("bigint"))


def shuffled(strata=None):
    def run(spark, folder):
        orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
        rows = orders.count()
        made = shuffled_folds(orders, 5, F.col("o_orderkey"), 42, strata, rows_per_block=split_block(rows), rows=rows)
        return made.withColumn("fold", F.col("fold").cast("bigint"))
    return run


def grouped(spark, folder):
    """All orders of a customer share a fold: no customer may show up in two."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    made = shuffled_folds(orders, 5, F.col("o_orderkey"), 42, group="o_custkey")
    per = made.groupBy("o_custkey").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("orders"))
    return per.groupBy("folds").agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"))


def hashed(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    made = shuffled_folds(orders, 5, F.col("o_orderkey"), 42, exact=False)
    inside = F.col("fold").between(0, 4)
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("placed"), F.count_distinct("fold").alias("folds"))


def weighted(spark, folder):
    made = balanced_weights(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return made.withColumn("weight", F.round("weight", 6))


def positive(spark, folder):
    made = positive_weight(table(spark, folder, "labels"), "quality")
    return made.select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.round("weight", 6).alias("weight"))


def seeds(spark, folder):
    parts = table(spark, folder, "part")
    return parts.select("p_partkey", named_seed_column(F.col("p_name"), 42).alias("seed"))


def fold_sql(part: str) -> str:
    return f"""SELECT o_orderkey, o_orderpriority,
        (row_number() OVER ({part} ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) - 1) % 5 AS fold FROM orders"""


ENTRIES = [
    Entry("fold_temporal", temporal, f"""WITH {SNAPSHOTS},
        nu AS (SELECT ts, arrivals, row_number() OVER (ORDER BY ts) - 1 AS position, count(*) OVER () AS n FROM sn),
        te AS (SELECT *, n // 6 AS size FROM nu)
        SELECT ts, arrivals, position, CASE WHEN position < n - 5 * size THEN -1 ELSE (position - (n - 5 * size)) // size END AS fold FROM te"""),
    Entry("fold_shuffled", shuffled(), fold_sql("")),
    Entry("fold_stratified", shuffled("o_orderpriority"), fold_sql("PARTITION BY o_orderpriority")),
    Entry("fold_grouped", grouped, """
        SELECT 1 AS folds, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"""),
    Entry("fold_hashed", hashed, "SELECT count(*) AS rows, count(*) AS placed, CAST(5 AS BIGINT) AS folds FROM orders"),
    Entry("weight_balanced", weighted, """
        WITH ct AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY c)
        SELECT o_orderkey, o_orderpriority, round((SELECT sum(n) FROM ct) / ((SELECT count(*) FROM ct) * n), 6) AS weight
        FROM orders JOIN ct ON o_orderpriority = c"""),
    Entry("weight_positive", positive, """
        SELECT doc_id, CAST(quality AS BIGINT) AS quality, CASE WHEN quality = 1 THEN round((SELECT count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) FROM labels), 6) ELSE 1e0 END AS weight
        FROM labels"""),
    Entry("seed_named", seeds, """
        SELECT p_partkey, CAST('0x' || substr(sha256(p_name || ':42'), 1, 8) AS BIGINT) AS seed FROM part"""),
]
