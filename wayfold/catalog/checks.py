"""The checks before training, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, SNAPSHOTS, Entry, plain_journeys
from wayfold.operators.gate import Plan, class_findings, gate
from wayfold.operators.labels import wait_ratio_class
from wayfold.sources.event_tables import snapshots, table

SERIES_PLAN = Plan(
    "avg_wait", features=("arrivals", "avg_wait", "missing_one", "shift"), lookback="20d", horizon="20d",
    lags=("1h", "30d"), folds=1, strategy="stratified", algorithms=("gbt", "oracle"), metrics=("rmse", "luck"), seed=-1,
)
WINDOW_PLAN = Plan("avg_wait", lookback="28d", horizon="1h", lags=("1h",))
ENTITY_PLAN = Plan("status", "entity_classification", ("wait", "node"), point="sometimes", strategy="stratified")


def series_gate(spark, folder):
    return gate(snapshots(spark, folder).withColumn("shift", F.lit("day")), SERIES_PLAN).select("code", "field")


def window_gate(spark, folder):
    return gate(snapshots(spark, folder), WINDOW_PLAN).select("code", "field", "message")


def target_gate(spark, folder):
    """No such target and no time column; then a target that is no number."""
    sn = snapshots(spark, folder)
    missing = gate(sn.drop("ts"), Plan("no_such_column", lookback="1h", horizon="1h", lags=("1h",)))
    worded = gate(sn.withColumn("shift", F.lit("day")), Plan("shift", lookback="1h", horizon="1h", lags=("1h",)))
    found = missing.select(F.lit("missing").alias("plan"), "code", "field").unionByName(worded.select(F.lit("worded").alias("plan"), "code", "field"))
    return found.where("code <> 'V-02'")


def entity_gate(spark, folder):
    return gate(plain_journeys(spark, folder), ENTITY_PLAN).select("code", "field", "message")


def class_gate(spark, folder):
    """A numeric target with many values: every class too small is listed, however many there are."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("target"))
    return class_findings(events, "target").select("code", "message")


def derived_gate(spark, folder):
    return class_findings(wait_ratio_class(plain_journeys(spark, folder)), "wait_ratio_class").select("code", "message")


def fixed(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, '{where}' AS field" for code, where in rows)


SERIES_SQL = fixed([
    ("V-04", "features.feature_columns"), ("V-05", "features.feature_columns"), ("V-06", "features.feature_columns"),
    ("V-07", "seed"), ("V-08", "model.algorithms"), ("V-09", "model.cross_validation.folds"),
    ("V-10", "evaluation.metrics"), ("VT-05", "features.lag_intervals"), ("VT-06", "model.cross_validation.strategy"),
]) + """ UNION ALL SELECT 'VT-02', 'features.lookback' FROM (SELECT max(ts) - min(ts) AS span FROM sn) WHERE span < 40 * 86400
    UNION ALL SELECT 'V-02', 'dataset' FROM (SELECT count(*) AS n FROM sn) WHERE n < 50"""

ENTRIES = [
    Entry("gate_series", series_gate, f"WITH {SNAPSHOTS} {SERIES_SQL}"),
    Entry("gate_targets", target_gate, """
        SELECT 'missing' AS plan, 'V-03' AS code, 'features.target' AS field UNION ALL SELECT 'missing', 'VT-01', 'dataset'
        UNION ALL SELECT 'worded', 'VT-04', 'features.target'"""),
    Entry("gate_windows", window_gate, f"""WITH {SNAPSHOTS},
        fa AS (SELECT count(*) AS n, max(ts) - min(ts) AS span FROM sn),
        us AS (SELECT *, span - 28 * 86400 - 3600 AS usable, (span - 28 * 86400 - 3600) / (span / CAST(n - 1 AS DOUBLE)) AS windows FROM fa)
        SELECT 'V-02' AS code, 'dataset' AS field, n || ' rows, at least 50 needed' AS message FROM fa WHERE n < 50
        UNION ALL SELECT 'VT-02', 'features.lookback', 'lookback and horizon need 2422800 s, more than the data span' FROM us WHERE usable < 0
        UNION ALL SELECT 'VT-03', 'features.lookback', CAST(round(windows) AS BIGINT) || ' windows, at least 50 needed'
        FROM us WHERE usable > 0 AND windows < 50"""),
    Entry("gate_entity", entity_gate, f"""WITH {JOURNEYS}
        SELECT 'V-06' AS code, 'features.feature_columns' AS field, 'features not numeric: node' AS message
        UNION ALL SELECT 'VE-04', 'features.observation_point', 'unknown observation point sometimes'
        UNION ALL SELECT 'V-02', 'dataset', n || ' rows, at least 100 needed' FROM (SELECT count(*) AS n FROM tr) WHERE n < 100
        UNION ALL SELECT 'V-11', 'features.target', k || ' of the values of status are null'
        FROM (SELECT count(*) - count(status) AS k, count(*) AS n FROM tr) WHERE k / CAST(n AS DOUBLE) > 0.1
        UNION ALL SELECT 'VE-02', 'features.target', 'class ' || status || ' has ' || count(*) || ' rows, at least 10 needed'
        FROM tr WHERE status IS NOT NULL GROUP BY status HAVING count(*) < 10"""),
    Entry("gate_classes", class_gate, """
        SELECT 'VE-01' AS code, 'target has ' || k || ' distinct values' AS message FROM (SELECT count(DISTINCT user_id) AS k FROM events) WHERE k > 20
        UNION ALL SELECT 'VE-03', k || ' classes, at most 20 allowed' FROM (SELECT count(DISTINCT user_id) AS k FROM events) WHERE k > 20
        UNION ALL SELECT 'VE-02', 'class ' || user_id || ' has ' || count(*) || ' rows, at least 10 needed' FROM events
        GROUP BY user_id HAVING count(*) < 10"""),
    Entry("gate_derived_classes", derived_gate, f"""WITH {JOURNEYS},
        fin AS (SELECT eid, arg_max(s_cum_wait, step) AS w, arg_max(s_cum_processing, step) AS p FROM tr WHERE done GROUP BY eid),
        lab AS (SELECT eid, CASE WHEN coalesce(w / nullif(w + p, 0), 0) <= 0.3e0 THEN 'efficient'
          WHEN w / (w + p) <= 0.6e0 THEN 'moderate' ELSE 'congested' END AS lb FROM fin),
        al AS (SELECT coalesce(lb, 'unknown') AS lb FROM tr LEFT JOIN lab ON tr.eid = lab.eid)
        SELECT 'VE-02' AS code, 'class ' || lb || ' has ' || count(*) || ' rows, at least 10 needed' AS message
        FROM al GROUP BY lb HAVING count(*) < 10"""),
]
