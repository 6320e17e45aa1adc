"""Observation points, derived ratios and the entity feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, Entry, plain_journeys, rounded
from wayfold.catalog.labelling import NEAREST_DELAY, WAIT_CLASS
from wayfold.functions.durations import seconds_column
from wayfold.functions.encode import encoding_of
from wayfold.operators.classes import attach, class_table, with_weights
from wayfold.operators.folds import balanced_weights
from wayfold.functions.ratios import entity_ratios, observation_vector
from wayfold.operators.observation import drop_unknown, observe
from wayfold.operators.labels import wait_ratio_class
from wayfold.operators.selection import entity_features
from wayfold.plans.entity import entity_table
from wayfold.sources.event_tables import table

RATIOS = """
          round(CASE WHEN s_sys_node_count > 0 THEN s_steps_done / s_sys_node_count ELSE 0e0 END, 6) AS d_progress_ratio,
          round(CASE WHEN s_elapsed > 0 THEN s_cum_wait / s_elapsed ELSE 0e0 END, 6) AS d_wait_trend,
          round(CASE WHEN s_sys_util > 0 THEN s_node_util / s_sys_util ELSE 1e0 END, 6) AS d_util_relative,
          round(CASE WHEN s_elapsed > 0 THEN s_cum_cost / s_elapsed ELSE 0e0 END, 6) AS d_cost_rate"""
STATE = """round(s_elapsed, 6) AS s_elapsed, round(s_cum_wait, 6) AS s_cum_wait, round(s_cum_processing, 6) AS s_cum_processing,
          s_steps_done, round(s_cum_cost, 6) AS s_cum_cost, round(s_node_util, 6) AS s_node_util, s_node_avg_queue, s_sys_util, s_sys_node_count"""


def delayed_features(spark, folder, point="entry_only"):
    made = entity_table(plain_journeys(spark, folder), "delay_severity", point)
    doubles = [f.name for f in made.rows.schema.fields if f.dataType.typeName() == "double"]
    out = rounded(made.rows, *doubles)
    return out.withColumn("label", F.col("label").cast("bigint")).withColumn("s_sys_node_count", F.col("s_sys_node_count").cast("bigint"))


def ratios(spark, folder):
    tr = plain_journeys(spark, folder)
    return tr.select("eid", "step", *[F.round(e, 6).alias(n) for n, e in entity_ratios(tr.columns).items()])


def steps_at(point, **options):
    def run(spark, folder):
        return observe(plain_journeys(spark, folder), point, **options).select("eid", "step", "node")
    return run


def thinned(spark, folder):
    """Every other step is missing, so an exact midpoint often is."""
    tr = plain_journeys(spark, folder).where((F.col("step") % 2 == 0) | (F.col("step") > 3))
    return observe(tr, "midpoint", nearest=True).select("eid", "step", "node")


def encoded(spark, folder):
    orders = table(spark, folder, "orders")
    classes = encoding_of(orders, "o_orderpriority")
    lines = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("n"))
    numbers = encoding_of(lines, "n")
    texts = orders.select(F.lit("priority").alias("target"), F.col("o_orderpriority").alias("value"), classes.column("o_orderpriority").cast("bigint").alias("label"))
    counts = lines.select(F.lit("line").alias("target"), F.col("n").cast("string").alias("value"), numbers.column("n").cast("bigint").alias("label"))
    return texts.unionByName(counts).groupBy("target", "value", "label").agg(F.count(F.lit(1)).alias("rows"))


def many_classes(spark, folder):
    """A text target with 25 classes: their numbers, and weights that balance them."""
    rows = table(spark, folder, "events").select((F.col("user_id") % 25).cast("string").alias("kind"))
    encoding = encoding_of(rows, "kind")
    weighed = balanced_weights(rows.select("kind", encoding.column("kind").cast("bigint").alias("label")), "label")
    return weighed.groupBy("kind", "label").agg(F.round(F.first("weight"), 6).alias("weight"))


def part_classes(spark, folder):
    """Every part and supplier pair of the lines as a class of its own, by the table that large encodings use."""
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("kind"), "l_quantity")
    classes = with_weights(class_table(lines, "kind"))
    # As if the table of classes were too large to be sent to all tasks.
    coded = attach(lines, "kind", classes, {"label": "number", "weight": "weight"}, broadcast_classes=0)
    return coded.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.first("weight"), 6).alias("weight"))


def chosen(spark, folder):
    tr = plain_journeys(spark, folder).withColumn("s_attr_size", F.col("step") * 2).withColumn("sla_x", F.lit(1.0))
    columns = entity_features(tr, "status")
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f")
    return tr.select(names).groupBy(F.col("f.feature").alias("feature")).agg(F.round(F.sum("f.v"), 4).alias("total"))


CHOSEN = ["s_elapsed", "s_cum_wait", "s_cum_processing", "s_steps_done", "s_cum_cost", "s_node_util", "s_node_avg_queue", "s_sys_util", "s_sys_node_count"]


def vectors(spark, folder):
    tr = plain_journeys(spark, folder)
    names = ["s_cum_wait", "s_absent", "s_node_util", "s_steps_done"]
    made = tr.select("eid", "step", observation_vector(tr, names).alias("v"))
    return made.select("eid", "step", *[F.round(F.col("v")[i].cast("double"), 4).alias(f"v{i}") for i in (1, 2, 3)], F.size("v").cast("bigint").alias("size"))


def durations(spark, folder):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhdx"]), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat((F.floor(F.col("value") * 10) / 10).cast("string"), unit)
    return table(spark, folder, "events").select("event_id", seconds_column(text).alias("seconds"))


def known(spark, folder):
    return drop_unknown(wait_ratio_class(plain_journeys(spark, folder)), "wait_ratio_class").select("eid", "step", "wait_ratio_class")


def midpoint(rounding: str) -> str:
    return f"""WITH {JOURNEYS}, m AS (SELECT eid, CAST({rounding}(max(step) / 2{', 0' if 'even' in rounding else ''}) AS BIGINT) AS mid FROM tr GROUP BY eid)
        SELECT tr.eid, tr.step, tr.node FROM tr JOIN m ON tr.eid = m.eid AND tr.step = m.mid"""


FEATURES = f"""WITH {JOURNEYS}, lb AS ({NEAREST_DELAY})
        SELECT tr.eid, tr.step, {STATE}, {RATIOS}, delay_severity,
          CAST(CASE delay_severity WHEN 'major_delay' THEN 0 WHEN 'minor_delay' THEN 1 ELSE 2 END AS BIGINT) AS label
        FROM tr JOIN lb ON tr.eid = lb.eid AND tr.step = lb.step WHERE delay_severity <> 'unknown'"""

ENTRIES = [
    Entry("entity_class_table", part_classes, """
        WITH g AS (SELECT l_partkey || '-' || l_suppkey AS kind, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS label, n AS rows, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM g"""),
    Entry("entity_many_classes", many_classes, """
        WITH g AS (SELECT CAST(user_id % 25 AS VARCHAR) AS kind, count(*) AS n FROM events GROUP BY 1)
        SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS label, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM g"""),
    Entry("entity_delayed_at_entry", delayed_features, FEATURES + " AND tr.step = 0"),
    Entry("entity_delayed_all_steps", lambda s, f: delayed_features(s, f, "all_steps"), FEATURES),
    Entry("entity_ratios", ratios, f"WITH {JOURNEYS} SELECT eid, step, {RATIOS} FROM tr"),
    Entry("entity_entry_only", steps_at("entry_only"), f"WITH {JOURNEYS} SELECT eid, step, node FROM tr WHERE step = 0"),
    Entry("entity_midpoint", steps_at("midpoint"), midpoint("round")),
    Entry("entity_midpoint_half_even", steps_at("midpoint", tie="half_even"), midpoint("round_even")),
    Entry("entity_midpoint_nearest", thinned, f"""WITH {JOURNEYS},
        th AS (SELECT * FROM tr WHERE step % 2 = 0 OR step > 3),
        m AS (SELECT eid, CAST(round(max(step) / 2) AS BIGINT) AS mid FROM th GROUP BY eid),
        k AS (SELECT th.*, row_number() OVER (PARTITION BY th.eid ORDER BY abs(th.step - mid), th.step) AS rn FROM th JOIN m ON th.eid = m.eid)
        SELECT eid, step, node FROM k WHERE rn = 1"""),
    Entry("entity_known_labels", known, f"SELECT * FROM ({WAIT_CLASS}) WHERE wait_ratio_class <> 'unknown'"),
    Entry("entity_encoded_labels", encoded, """
        SELECT 'priority' AS target, o_orderpriority AS value, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label, count(*) AS rows
        FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), dense_rank() OVER (ORDER BY l_linenumber) - 1, count(*)
        FROM lineitem GROUP BY l_linenumber"""),
    Entry("entity_selected_columns", chosen, f"WITH {JOURNEYS} " + " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, round(CAST(sum({c}) AS DOUBLE), 4) AS total FROM tr" for c in CHOSEN]
        + ["SELECT 's_attr_size', round(CAST(sum(step * 2) AS DOUBLE), 4) FROM tr"])),
    Entry("entity_observation_vector", vectors, f"""WITH {JOURNEYS}
        SELECT eid, step, 0e0 AS v1, round(CAST(CAST(s_node_util AS FLOAT) AS DOUBLE), 4) AS v2, CAST(s_steps_done AS DOUBLE) AS v3,
          CAST(4 AS BIGINT) AS size FROM tr"""),
    Entry("duration_seconds", durations, """
        SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE
          CAST(floor(CAST(CAST(floor(value * 10) / 10 AS VARCHAR) AS DOUBLE) * CASE event_id % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 60e0 WHEN 2 THEN 3600e0 ELSE 86400e0 END) AS BIGINT)
          END AS seconds FROM events"""),
]
