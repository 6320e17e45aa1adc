"""Derived labels and the aggregations behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, Entry, nearest_sql, plain_journeys, r6, split_journeys
from wayfold.operators.labels import delay_severity, derive, final_values, label_distribution, sla_breach, wait_ratio_class
from wayfold.operators.quantile import quantiles
from wayfold.session import cut_lineage
from wayfold.sources.event_tables import table

LIMITED = JOURNEYS + """,
tl AS (SELECT *, CASE WHEN node = 'view' THEN 3000e0 ELSE 9000e0 END AS sla_resolution_limit, 100e0 AS sla_a FROM tr)"""


def shown(tr):
    measures = ("wait", "processing", "total_time", "t_enter", "s_cum_wait", "s_cum_processing", "s_cum_cost")
    return tr.select("eid", "step", "node", "done", "status", *[r6(c).alias(c) for c in measures])


def limited(spark, folder):
    limit = F.when(F.col("node") == "view", 3000.0).otherwise(9000.0)
    return plain_journeys(spark, folder).withColumn("sla_resolution_limit", limit).withColumn("sla_a", F.lit(100.0))


def slim(df, label):
    return df.select("eid", "step", label)


def measured(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    tr = cut_lineage(plain_journeys(spark, folder).select("total_time"), "journeys")
    rows = []
    for name, df, column in (("price", lineitem, "l_extendedprice"), ("quantity", lineitem, "l_quantity"), ("total", tr, "total_time")):
        for method in ("nearest", "linear"):
            # A tiny bracket makes the narrowing search do its work on the tables at hand.
            values = quantiles(df, column, [0.33, 0.66, 0.75], method, bracket_limit=500)
            rows += [(name, method, q, round(v, 6)) for q, v in zip((0.33, 0.66, 0.75), values)]
    return spark.createDataFrame(rows, "name string, method string, q double, value double")


def finals(spark, folder):
    found = final_values(plain_journeys(spark, folder), "total_time", "s_cum_wait")
    return found.select("eid", "last_step", "completed", r6("total_time").alias("total_time"), r6("s_cum_wait").alias("s_cum_wait"))


def quantile_rows() -> str:
    parts = []
    for name, source, column in (("price", "lineitem", "l_extendedprice"), ("quantity", "lineitem", "l_quantity"), ("total", "tr", "total_time")):
        for q in ("0.33", "0.66", "0.75"):
            parts.append(f"SELECT '{name}' AS name, 'nearest' AS method, {q}e0 AS q, round({nearest_sql(column, source, q + 'e0')}, 6) AS value")
            parts.append(f"SELECT '{name}', 'linear', {q}e0, round(quantile_cont({column}, {q}e0), 6) FROM {source}")
    return " UNION ALL ".join(parts)


def delay_sql(p33: str, p66: str) -> str:
    return f"""WITH {JOURNEYS},
        fin AS (SELECT eid, arg_max(total_time, step) AS total_time, arg_max(s_cum_wait, step) AS w FROM tr WHERE done GROUP BY eid),
        ra AS (SELECT eid, CASE WHEN total_time > 0 THEN w / total_time ELSE 0e0 END AS x FROM fin),
        cut AS (SELECT {p33} AS p33, {p66} AS p66),
        lab AS (SELECT eid, CASE WHEN x <= p33 THEN 'on_time' WHEN x <= p66 THEN 'minor_delay' ELSE 'major_delay' END AS lb FROM ra, cut)
        SELECT tr.eid, tr.step, coalesce(lb, 'unknown') AS delay_severity FROM tr LEFT JOIN lab ON tr.eid = lab.eid"""


NEAREST_DELAY = delay_sql(nearest_sql("x", "ra", "0.33e0"), nearest_sql("x", "ra", "0.66e0"))
LINEAR_DELAY = delay_sql("(SELECT quantile_cont(x, 0.33e0) FROM ra)", "(SELECT quantile_cont(x, 0.66e0) FROM ra)")


def breach_sql(limit: str) -> str:
    return f"""WITH {JOURNEYS},
        lab AS (SELECT eid, CASE WHEN max(total_time) > {limit} THEN 'breach' ELSE 'no_breach' END AS lb FROM tr WHERE done GROUP BY eid)
        SELECT tr.eid, tr.step, coalesce(lb, 'unknown') AS sla_breach FROM tr LEFT JOIN lab ON tr.eid = lab.eid"""


def column_breach_sql(limit: str) -> str:
    return f"""WITH {LIMITED},
        lab AS (SELECT eid, CASE WHEN arg_max(total_time, step) > arg_max({limit}, step) THEN 'breach' ELSE 'no_breach' END AS lb
                FROM tl WHERE done GROUP BY eid)
        SELECT tr.eid, tr.step, coalesce(lb, 'unknown') AS sla_breach FROM tr LEFT JOIN lab ON tr.eid = lab.eid"""


WAIT_CLASS = f"""WITH {JOURNEYS},
        fin AS (SELECT eid, arg_max(s_cum_wait, step) AS w, arg_max(s_cum_processing, step) AS p FROM tr WHERE done GROUP BY eid),
        ra AS (SELECT eid, CASE WHEN w + p > 0 THEN w / (w + p) ELSE 0e0 END AS x FROM fin),
        lab AS (SELECT eid, CASE WHEN x <= 0.3e0 THEN 'efficient' WHEN x <= 0.6e0 THEN 'moderate' ELSE 'congested' END AS lb FROM ra)
        SELECT tr.eid, tr.step, coalesce(lb, 'unknown') AS wait_ratio_class FROM tr LEFT JOIN lab ON tr.eid = lab.eid"""

SHOWN = f"""WITH {JOURNEYS}
        SELECT eid, step, node, done, status, round(wait, 6) AS wait, round(processing, 6) AS processing,
          round(total_time, 6) AS total_time, round(t_enter, 6) AS t_enter, round(s_cum_wait, 6) AS s_cum_wait,
          round(s_cum_processing, 6) AS s_cum_processing, round(s_cum_cost, 6) AS s_cum_cost FROM tr"""

ENTRIES = [
    Entry("journeys_from_events", lambda s, f: shown(plain_journeys(s, f)), SHOWN),
    Entry("journeys_in_blocks", lambda s, f: shown(split_journeys(s, f)), SHOWN),
    Entry("agg_final_values", finals, f"""WITH {JOURNEYS}
        SELECT eid, max(step) AS last_step, bool_or(done) AS completed,
          round(arg_max(total_time, step) FILTER (done), 6) AS total_time,
          round(arg_max(s_cum_wait, step) FILTER (done), 6) AS s_cum_wait FROM tr GROUP BY eid"""),
    Entry("agg_quantiles", measured, f"WITH {JOURNEYS} {quantile_rows()}"),
    Entry("labels_sla_fixed", lambda s, f: slim(sla_breach(plain_journeys(s, f), threshold=6000.0), "sla_breach"), breach_sql("6000e0")),
    Entry("labels_sla_column", lambda s, f: slim(sla_breach(limited(s, f), limit="sla_a"), "sla_breach"), column_breach_sql("sla_a")),
    Entry("labels_sla_detected", lambda s, f: slim(sla_breach(limited(s, f)), "sla_breach"), column_breach_sql("sla_resolution_limit")),
    Entry("labels_sla_fallback", lambda s, f: slim(derive(plain_journeys(s, f), "sla_breach"), "sla_breach"),
          breach_sql(nearest_sql("total_time", "(SELECT * FROM tr WHERE done)", "0.75e0"))),
    Entry("labels_delay_severity", lambda s, f: slim(delay_severity(plain_journeys(s, f)), "delay_severity"), NEAREST_DELAY),
    Entry("labels_delay_severity_linear", lambda s, f: slim(delay_severity(plain_journeys(s, f), method="linear"), "delay_severity"), LINEAR_DELAY),
    Entry("labels_wait_ratio_class", lambda s, f: slim(wait_ratio_class(plain_journeys(s, f)), "wait_ratio_class"), WAIT_CLASS),
    Entry("labels_distribution", lambda s, f: label_distribution(wait_ratio_class(plain_journeys(s, f)), "wait_ratio_class"), f"""
        SELECT wait_ratio_class, count(*) AS rows, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent
        FROM ({WAIT_CLASS}) GROUP BY wait_ratio_class"""),
]
