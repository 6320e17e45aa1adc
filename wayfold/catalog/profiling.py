"""Profiles, quality checks and target discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, OFF_TIES, SNAPSHOTS, Entry, nearest_sql, plain_journeys
from wayfold.operators.discovery import class_balance, entity_targets, entity_targets_from_profile, series_targets
from wayfold.operators.profile import category_counts, column_profile, full_profile
from wayfold.operators.quality import constant_columns, duplicate_rows, missing_rates, quality_report, size_grade
from wayfold.operators.sketches import column_sketches, joint_profile, joint_quantiles
from wayfold.session import cut_lineage
from wayfold.sources.event_tables import snapshots, table


def profile_sql(source: str, numeric: list[str], text: list[str]) -> str:
    """One row per column, in DuckDB."""
    rows = []
    for c in [*numeric, *text]:
        stats = (
            f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max"
            if c in numeric
            else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
        )
        rows.append(
            f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_rate, "
            f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS unique_count, "
            f"{'true' if c in numeric else 'false'} AS is_numeric, {'true' if c in text else 'false'} AS is_categorical, "
            f"{stats} FROM {source}"
        )
    return " UNION ALL ".join(rows)


def columns_of(df):
    return df.drop("dtype")


def orders_profile(spark, folder):
    orders = table(spark, folder, "orders").drop("o_orderdate")
    return columns_of(column_profile(orders))


def journeys_profile(spark, folder):
    tr = plain_journeys(spark, folder).select("eid", "step", "node", "wait", "total_time", "status", "s_node_avg_queue")
    return columns_of(column_profile(tr))


def sketched(spark, folder):
    return columns_of(column_profile(table(spark, folder, "lineitem"), exact=False))


def sketch_error(spark, folder):
    """Are sketched distinct counts within three times their stated relative error (0.05)?"""
    line = table(spark, folder, "lineitem")
    exact, near = (column_profile(line, exact=e).select("name", F.col("unique_count").alias(n)) for e, n in ((True, "e"), (False, "s")))
    return exact.join(near, "name").select("name", (F.abs(F.col("e") - F.col("s")) <= 0.15 * F.col("e")).alias("within"))


def versions(spark, folder):
    """Lines of three return flags as three tables with a sketch each, as if registered one after another."""
    line = table(spark, folder, "lineitem")
    parts = [line.where(F.col("l_returnflag") == flag) for flag in "ANR"]
    return [(part, cut_lineage(column_sketches(part), "sketches")) for part in parts]


def joined_sketches(spark, folder):
    """The profile of three tables from their sketches; is each distinct count within three standard errors (0.05)?"""
    first, second, third = (s for _, s in versions(spark, folder))
    merged = joint_profile(first.unionByName(second).unionByName(third), places=12)
    exact = column_profile(table(spark, folder, "lineitem")).select("name", F.col("unique_count").alias("e"))
    near = F.abs(F.col("unique_count") - F.col("e")) <= 0.05 * F.col("e")
    return merged.join(exact, "name").select("name", "rows", "null_count", "is_numeric", *[F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in ("mean", "std", "min", "max")], near.alias("within"))


def joined_quantiles(spark, folder):
    parts, rows = versions(spark, folder), []
    for column in ("l_extendedprice", "l_quantity"):
        for method in ("nearest", "linear"):
            values = joint_quantiles(parts, column, SHARES, method, bracket_limit=500)
            rows += [(column, method, q, round(v, 6)) for q, v in zip(SHARES, values, strict=True)]
    return spark.createDataFrame(rows, "name string, method string, q double, value double")


def categories(spark, folder):
    return category_counts(table(spark, folder, "documents"), ["lang", "source"]).unionByName(
        category_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])
    )


def listed(spark, folder):
    tr = plain_journeys(spark, folder).select("node", "status", "step")
    found = full_profile(tr).where("is_categorical")
    return found.select(
        "name", "unique_count", F.concat_ws(",", "categories").alias("categories"),
        F.concat_ws(",", F.transform(F.map_entries("category_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("counts"),
    )


def grades(spark, folder):
    found = None
    for name in ("region", "nation", "supplier", "part", "documents", "events"):
        part = table(spark, folder, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("name"), F.col("n").alias("rows"), size_grade(F.col("n")).alias("grade")
        )
        found = part if found is None else found.unionByName(part)
    return found


SHARES = [0.33, 0.66, 0.75]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]
JOINED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS null_count, {'true' if c in LINE_NUMBERS else 'false'} AS is_numeric, "
    + ", ".join(
        f"round(CAST({fn}({c}) AS DOUBLE) + {OFF_TIES}, 6) AS {a}" if c in LINE_NUMBERS else f"CAST(NULL AS DOUBLE) AS {a}"
        for fn, a in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )
    + ", true AS within FROM lineitem"
    for c in [*LINE_NUMBERS, *LINE_TEXTS]
)
JOINED_QUANTILES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, 'nearest' AS method, {q}e0 AS q, round({nearest_sql(c, 'lineitem', f'{q}e0')}, 6) AS value "
    f"UNION ALL SELECT '{c}', 'linear', {q}e0, round(quantile_cont({c}, {q}e0), 6) FROM lineitem"
    for c in ("l_extendedprice", "l_quantity") for q in SHARES
)
GRADE = "CASE WHEN count(*) >= 1000 THEN 'excellent' WHEN count(*) >= 200 THEN 'good' WHEN count(*) >= 50 THEN 'minimal' ELSE 'insufficient' END"
CHECKED = ["eid", "total_time", "status", "s_sys_node_count"]


def checked(spark, folder):
    return plain_journeys(spark, folder).select(*CHECKED)


def repeated(spark, folder):
    return duplicate_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


def report(spark, folder):
    return quality_report(checked(spark, folder)).drop("message")


def found_entity(spark, folder):
    found = entity_targets(plain_journeys(spark, folder))
    return found.select("column", "task", "is_default", "null_rate", "unique_count", F.concat_ws(",", "classes").alias("classes"))


def found_fallback(spark, folder):
    found = entity_targets(table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"))
    return found.select("column", "task", "is_default", "null_rate", "unique_count", F.concat_ws(",", "classes").alias("classes"))


def found_stored(spark, folder):
    found = entity_targets_from_profile(full_profile(plain_journeys(spark, folder).select("status", "step")))
    return found.select(
        "column", "null_rate", "unique_count", F.concat_ws(",", "classes").alias("classes"),
        F.col("class_balance")["completed"].alias("completed_share"), F.col("class_balance")["failed"].alias("failed_share"),
    )


def found_series(spark, folder):
    return series_targets(column_profile(snapshots(spark, folder)))


MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, "
    f"(count(*) - count({c})) / CAST(count(*) AS DOUBLE) > 0.3 AS issue FROM tr" for c in CHECKED
)
CONSTANT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS constant FROM tr" for c in CHECKED
)
COPIES = f"SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CHECKED)} FROM tr)) AS d FROM tr"
REPORT = f"""
    SELECT 'size' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value,
      CASE WHEN count(*) < 50 THEN 'issue' ELSE 'info' END AS level FROM tr
    UNION ALL SELECT 'missing', "column", missing_rate, CASE WHEN issue THEN 'issue' ELSE 'info' END FROM ({MISSING})
    UNION ALL SELECT 'constant', "column", 1e0, 'warning' FROM ({CONSTANT}) WHERE constant
    UNION ALL SELECT 'duplicates', NULL, CAST(n - d AS DOUBLE),
      CASE WHEN (n - d) / CAST(n AS DOUBLE) > 0.1 THEN 'issue' ELSE 'info' END FROM ({COPIES})"""

SERIES_NUMBERS = [
    "arrivals", "n_click_queue", "n_error_queue", "n_purchase_queue", "n_signup_queue", "n_view_queue", "in_queue",
    "busy", "avg_wait",
]

ENTRIES = [
    Entry("profile_sketch_error", sketch_error, "SELECT column_name AS name, true AS within FROM (DESCRIBE lineitem)"),
    Entry("profile_orders", orders_profile, profile_sql(
        "orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])),
    Entry("profile_journeys", journeys_profile, f"WITH {JOURNEYS} " + profile_sql(
        "tr", ["step", "wait", "total_time", "s_node_avg_queue"], ["eid", "node", "status"])),
    Entry("profile_sketched", sketched),
    Entry("profile_joined_sketches", joined_sketches, JOINED_SQL),
    Entry("profile_joined_quantiles", joined_quantiles, JOINED_QUANTILES_SQL),
    Entry("profile_categories", categories, """
        SELECT 'lang' AS name, lang AS category, count(*) AS rows FROM documents WHERE lang IS NOT NULL GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
        UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority"""),
    Entry("profile_listed_categories", listed, f"""WITH {JOURNEYS},
        c AS (SELECT 'node' AS name, node AS v, count(*) AS n FROM tr GROUP BY node
              UNION ALL SELECT 'status', status, count(*) FROM tr GROUP BY status)
        SELECT name, count(*) AS unique_count, string_agg(v, ',' ORDER BY v) AS categories,
          string_agg(v || '=' || n, ',' ORDER BY v) FILTER (v IS NOT NULL) AS counts FROM c GROUP BY name"""),
    Entry("quality_size_grade", grades, " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS rows, {GRADE} AS grade FROM {n}"
        for n in ("region", "nation", "supplier", "part", "documents", "events"))),
    Entry("quality_missing", lambda s, f: missing_rates(checked(s, f)), f"WITH {JOURNEYS} {MISSING}"),
    Entry("quality_constant", lambda s, f: constant_columns(checked(s, f)), f"WITH {JOURNEYS} {CONSTANT}"),
    Entry("quality_duplicates", repeated, """
        SELECT CAST(n AS BIGINT) AS row_count, CAST(n - d AS BIGINT) AS duplicate_count,
          round((n - d) / CAST(n AS DOUBLE), 6) AS duplicate_rate
        FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS d
              FROM lineitem)"""),
    Entry("quality_report", report, f"WITH {JOURNEYS} {REPORT}"),
    Entry("discovery_class_balance", lambda s, f: class_balance(plain_journeys(s, f), "status"), f"""WITH {JOURNEYS}
        SELECT status AS label, count(*) AS rows, round(count(*) / (SELECT count(status) FROM tr), 6) AS share
        FROM tr WHERE status IS NOT NULL GROUP BY status"""),
    Entry("discovery_series_targets", found_series, f"""WITH {SNAPSHOTS}
        SELECT name AS "column", 'regression' AS task, name = 'avg_wait' AS is_default, null_rate, mean, std, min, max, unique_count
        FROM ({profile_sql('sn', SERIES_NUMBERS, [])})"""),
    Entry("discovery_entity_targets", found_entity, f"""WITH {JOURNEYS}
        SELECT 'status' AS "column", 'classification' AS task, true AS is_default,
          round((count(*) - count(status)) / CAST(count(*) AS DOUBLE), 6) AS null_rate,
          count(DISTINCT status) AS unique_count, 'completed,failed' AS classes FROM tr
        UNION ALL SELECT 'sla_breach', 'classification', false, NULL, NULL, 'no_breach,breach'
        UNION ALL SELECT 'delay_severity', 'classification', false, NULL, NULL, 'on_time,minor_delay,major_delay'"""),
    Entry("discovery_text_targets", found_fallback, """
        SELECT 'o_orderstatus' AS "column", 'classification' AS task, true AS is_default, 0e0 AS null_rate,
          count(DISTINCT o_orderstatus) AS unique_count,
          (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)) AS classes FROM orders
        UNION ALL SELECT 'o_orderpriority', 'classification', false, 0e0, count(DISTINCT o_orderpriority),
          (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) FROM orders"""),
    Entry("discovery_stored_targets", found_stored, f"""WITH {JOURNEYS}
        SELECT 'status' AS "column", round((count(*) - count(status)) / CAST(count(*) AS DOUBLE), 6) AS null_rate,
          count(DISTINCT status) + 1 AS unique_count, 'completed,failed' AS classes,
          round(count(*) FILTER (status = 'completed') / count(status), 6) AS completed_share,
          round(count(*) FILTER (status = 'failed') / count(status), 6) AS failed_share FROM tr"""),
]
