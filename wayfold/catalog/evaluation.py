"""Measures over predictions made from the given tables by fixed rules, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import Entry, r6, rounded, split_block
from wayfold.operators.compare import common_metrics, compare_experiments, fold_summary, rank_algorithms, top_importance
from wayfold.operators.metrics import (
    auc_binary,
    auc_one_vs_rest,
    class_scores,
    classification_metrics,
    confusion_matrix,
    evaluate,
    imbalance_report,
    prediction_sample,
    regression_metrics,
)
from wayfold.sources.event_tables import table

REGRESSION = ["rmse", "mae", "mape", "r2"]
COUNTED = ["f1_weighted", "f1_macro", "precision", "recall", "accuracy"]
CLASSES = 5


def prices(spark, folder):
    """Line prices guessed from the quantity."""
    line = table(spark, folder, "lineitem")
    return line.select(
        "l_returnflag", "l_orderkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("y_pred")
    )


def grades(spark, folder):
    """Document quality guessed from the length."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    score = (F.col("n_chars") % 100) / F.lit(100.0)
    # The labels are a subset of the documents by key, so the join spreads over doc_id.
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("y_pred"),
        F.array(1 - score, score).alias("proba"),
    )


def priorities(spark, folder):
    """Order priority (five classes) guessed from keys."""
    orders = table(spark, folder, "orders")
    scores = F.array(*[((F.col("o_orderkey") * (i + 3) + F.col("o_custkey")) % 97) / F.lit(97.0) for i in range(CLASSES)])
    return orders.select(
        "o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"),
        (F.col("o_custkey") % CLASSES).cast("int").alias("y_pred"), scores.alias("proba"),
    )


def split_areas(spark, folder):
    rows = priorities(spark, folder)
    block = split_block(rows.count() * CLASSES)
    return rounded(auc_one_vs_rest(rows, "y", "proba", CLASSES, rows_per_block=block, split=True), "auc_roc")


def class_table(spark, folder):
    found = class_scores(priorities(spark, folder))
    return rounded(found.withColumn("class", F.col("class").cast("bigint")), "precision", "recall", "f1")


def matrix(spark, folder):
    found = confusion_matrix(priorities(spark, folder), list(range(CLASSES)))
    return found.withColumn("actual", F.col("actual").cast("bigint"))


def named(spark, folder):
    values = evaluate(grades(spark, folder), ["accuracy", "auc_roc", "f1_weighted"], "classification", 2, "proba")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in values.items()], "metric string, value double")


def sample(spark, folder):
    found = prediction_sample(grades(spark, folder), ["doc_id"], 100, "proba")
    return found.select(
        "doc_id", F.col("y").cast("bigint").alias("y"), F.col("y_pred").cast("bigint").alias("y_pred"),
        F.col("probabilities")[1].alias("p1"),
    )


def fold_scores(spark, folder):
    """Per "algorithm" (ship year) and fold (line number): error of the price guess."""
    line = table(spark, folder, "lineitem").select(
        F.concat(F.lit("a"), F.year("l_shipdate").cast("string")).alias("algorithm"), F.col("l_linenumber").alias("fold"),
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("y_pred"),
    )
    wide = regression_metrics(line, ["rmse", "mae"], ["algorithm", "fold"])
    return wide.select("algorithm", "fold", F.expr("stack(2, 'rmse', rmse, 'mae', mae) as (metric, value)"))


def experiments(spark, folder):
    """One record per user: status by the user id, metrics from that user's events."""
    events = table(spark, folder, "events").where("user_id is not null")
    per = events.groupBy("user_id").agg(
        F.avg("value").alias("a"), F.max("value").alias("m"), F.sum("value").alias("s")
    )
    full = F.create_map(F.lit("f1_macro"), r6("a"), F.lit("rmse"), r6("m"), F.lit("recall"), r6("s"))
    part = F.create_map(F.lit("f1_macro"), r6("a"), F.lit("rmse"), r6("m"))
    return per.select(
        F.concat(F.lit("e"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("experiment_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("user_id") % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("user_id") % 3 == 0, part).otherwise(full).alias("metrics"),
    )


def compared(spark, folder):
    found = compare_experiments(experiments(spark, folder), rank_by="rmse")
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def importances(spark, folder):
    """Parts ranked by signed price deviation, as a stand-in for raw importances."""
    parts = table(spark, folder, "part")
    raw = parts.groupBy(F.col("p_type").alias("feature")).agg(F.sum(F.col("p_retailprice") - 1400).alias("raw"))
    return rounded(top_importance(raw, 20), "importance").withColumn("rank", F.col("rank").cast("bigint"))


def balance(spark, folder):
    orders = table(spark, folder, "orders")
    found = imbalance_report(orders.withColumn("fold", F.col("o_custkey") % 4), "o_orderpriority", "fold")
    return rounded(found, "minority_share", "imbalance_ratio")


PRICES = "pr AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
ERRORS = """round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
          round(coalesce(avg(abs((y - p) / y)) FILTER (y <> 0), 0e0), 6) AS mape,
          round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2"""
GRADES = """gr AS (SELECT doc_id, quality AS y, n_chars % 100 / 100e0 AS score,
          CASE WHEN n_chars % 100 / 100e0 >= 0.5e0 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"""
PRIORITIES = "gr AS (SELECT o_orderkey, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS y, CAST(o_custkey % 5 AS INT) AS p FROM orders)"
PER_CLASS = """cl AS (SELECT y AS c FROM gr UNION SELECT p FROM gr),
        cs AS (SELECT c, (SELECT count(*) FROM gr WHERE y = c) AS support, (SELECT count(*) FROM gr WHERE p = c) AS predicted,
               (SELECT count(*) FROM gr WHERE y = c AND p = c) AS hits FROM cl),
        sc AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0e0) AS pre, coalesce(hits / nullif(support, 0), 0e0) AS rec,
               coalesce(2 * hits / nullif(predicted + support, 0), 0e0) AS f1 FROM cs)"""
COUNTED_SQL = """SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
          round(sum(pre * support) / sum(support), 6) AS "precision", round(sum(rec * support) / sum(support), 6) AS recall,
          round(sum(hits) / sum(support), 6) AS accuracy FROM sc"""
AUC = """(SELECT (sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n) FROM (
          SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r,
            count(*) FILTER (y = 1) OVER () AS p, count(*) FILTER (y = 0) OVER () AS n FROM gr) GROUP BY p, n)"""
OVR_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS c, CASE WHEN y = {i} THEN 1 ELSE 0 END AS hit, (o_orderkey * {i + 3} + o_custkey) % 97 / 97e0 AS score FROM gr"
    for i in range(CLASSES))
FOLD_SCORES = """fs AS (SELECT 'a' || year(l_shipdate) AS algorithm, l_linenumber AS fold,
          sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)) AS rmse, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae
          FROM lineitem GROUP BY ALL),
        su AS (SELECT algorithm, 'rmse' AS metric, avg(rmse) AS mean, stddev_pop(rmse) AS std, count(rmse) AS folds FROM fs GROUP BY algorithm
          UNION ALL SELECT algorithm, 'mae', avg(mae), stddev_pop(mae), count(mae) FROM fs GROUP BY algorithm)"""

OVR = f"""WITH {PRIORITIES}, pt AS ({OVR_ROWS}),
        rk AS (SELECT c, hit, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2e0 AS r FROM pt),
        ar AS (SELECT c, CAST(sum(hit) AS DOUBLE) AS p, count(*) - CAST(sum(hit) AS DOUBLE) AS n, sum(r) FILTER (hit = 1) AS s FROM rk GROUP BY c)
        SELECT round(sum((s - p * (p + 1) / 2) / (p * n) * p) / sum(p), 6) AS auc_roc FROM ar"""

ENTRIES = [
    Entry("eval_regression", lambda s, f: rounded(regression_metrics(prices(s, f), REGRESSION), *REGRESSION), f"WITH {PRICES} SELECT {ERRORS} FROM pr"),
    Entry("eval_regression_by_group", lambda s, f: rounded(regression_metrics(prices(s, f), REGRESSION, ["l_returnflag"]), *REGRESSION),
          f"WITH {PRICES} SELECT l_returnflag, {ERRORS} FROM pr GROUP BY l_returnflag"),
    Entry("eval_classification", lambda s, f: rounded(classification_metrics(priorities(s, f), COUNTED), *COUNTED), f"WITH {PRIORITIES}, {PER_CLASS} {COUNTED_SQL}"),
    Entry("eval_classification_binary", lambda s, f: rounded(classification_metrics(grades(s, f), COUNTED), *COUNTED), f"WITH {GRADES}, {PER_CLASS} {COUNTED_SQL}"),
    Entry("eval_per_class", class_table, f"""WITH {PRIORITIES}, {PER_CLASS}
        SELECT CAST(c AS BIGINT) AS class, support, predicted, hits, round(pre, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1 FROM sc"""),
    Entry("eval_auc_binary", lambda s, f: rounded(auc_binary(grades(s, f), F.col("y") == 1, F.col("score"), rows_per_block=split_block(400), split=True), "auc_roc"),
          f"WITH {GRADES} SELECT round({AUC}, 6) AS auc_roc"),
    Entry("eval_auc_one_vs_rest", lambda s, f: rounded(auc_one_vs_rest(priorities(s, f), "y", "proba", CLASSES), "auc_roc"), OVR),
    Entry("eval_auc_in_blocks", split_areas, OVR),
    Entry("eval_named_metrics", named, f"""WITH {GRADES}, {PER_CLASS}
        SELECT 'accuracy' AS metric, round(sum(hits) / sum(support), 6) AS value FROM sc
        UNION ALL SELECT 'f1_weighted', round(sum(f1 * support) / sum(support), 6) FROM sc
        UNION ALL SELECT 'auc_roc', round({AUC}, 6)"""),
    Entry("eval_confusion_matrix", matrix, f"WITH {PRIORITIES} SELECT CAST(y AS BIGINT) AS actual, " + ", ".join(
        f"count(*) FILTER (p = {i}) AS pred_{i}" for i in range(CLASSES)) + " FROM gr GROUP BY y"),
    Entry("eval_prediction_sample", sample, f"""WITH {GRADES}
        SELECT doc_id, CAST(y AS BIGINT) AS y, CAST(p AS BIGINT) AS y_pred, round(score, 4) AS p1 FROM gr ORDER BY doc_id LIMIT 100"""),
    Entry("eval_fold_summary", lambda s, f: rounded(fold_summary(fold_scores(s, f)), "mean", "std"),
          f"WITH {FOLD_SCORES} SELECT algorithm, metric, round(mean, 6) AS mean, round(std, 6) AS std, folds FROM su"),
    Entry("eval_rank_algorithms", lambda s, f: rounded(rank_algorithms(fold_summary(fold_scores(s, f)), "rmse"), "mean", "std").withColumn("rank", F.col("rank").cast("bigint")),
          f"""WITH {FOLD_SCORES} SELECT algorithm, metric, round(mean, 6) AS mean, round(std, 6) AS std,
          row_number() OVER (ORDER BY mean, algorithm) AS rank FROM su WHERE metric = 'rmse'"""),
    Entry("eval_common_metrics", lambda s, f: common_metrics(experiments(s, f)), """
        SELECT unnest(CASE WHEN count(*) FILTER (user_id % 3 = 0) > 0 THEN ['f1_macro', 'rmse'] ELSE ['f1_macro', 'rmse', 'recall'] END) AS metric
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 0)"""),
    Entry("eval_compare_experiments", compared, """
        WITH pe AS (SELECT user_id, round(avg(value), 6) AS f1_macro, round(max(value), 6) AS rmse FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)
        SELECT 'e' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS experiment_id, 'user ' || user_id AS name, f1_macro, rmse,
          row_number() OVER (ORDER BY rmse, lpad(CAST(user_id AS VARCHAR), 8, '0')) AS rank FROM pe"""),
    Entry("eval_top_importance", importances, """
        WITH ra AS (SELECT p_type AS feature, abs(sum(p_retailprice - 1400)) AS raw FROM part GROUP BY p_type)
        SELECT feature, round(raw / (SELECT sum(raw) FROM ra), 6) AS importance, row_number() OVER (ORDER BY raw DESC, feature) AS rank
        FROM ra ORDER BY rank LIMIT 20"""),
    Entry("eval_imbalance", balance, """
        WITH ct AS (SELECT o_custkey % 4 AS fold, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL)
        SELECT fold, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, round(min(n) / sum(n), 6) AS minority_share,
          round(max(n) / min(n), 6) AS imbalance_ratio, count(*) = 1 AS single_class FROM ct GROUP BY fold"""),
]
