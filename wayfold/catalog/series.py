"""Series windows; most run over split blocks here, as they would on a long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import OFF_TIES, SNAPSHOTS, Entry, rounded, split_block
from wayfold.functions.features import FeatureDefinition, FeatureStore
from wayfold.functions.ratios import guarded, imbalance, node_columns, queue_to_busy
from wayfold.operators.blocks import ROWS_PER_BLOCK
from wayfold.operators.series import bucket_interval, lag, rolling_mean, rolling_std, target_ahead, trend, with_running_sums
from wayfold.plans.series import prepared, series_table
from wayfold.sources.event_tables import NODES, snapshots, table



def windowed(build, before=0, after=0):
    """A query of window columns over the hourly snapshots, in blocks."""
    def run(spark, folder):
        sn = snapshots(spark, folder)
        spacing = bucket_interval(sn)
        ready = prepared(sn, None, before, after, spacing.rows, split_block(spacing.rows))
        built = build(ready.window)
        out = ready.select(*[F.round(c.cast("double"), 6).alias(n) for n, c in built.items()]).finish()
        return out.select(F.col("ts").cast("bigint").alias("ts"), *built)
    return run


def whole(spark, folder, split=False):
    sn = snapshots(spark, folder)
    found = bucket_interval(sn)
    made = series_table(
        sn, interval=found, rolling=("2h", "4h"), columns=["arrivals", "in_queue", "busy", *[f"n_{n}_queue" for n in NODES]],
        rows_per_block=split_block(found.rows) if split else ROWS_PER_BLOCK,
    )
    return rounded(made.rows.withColumn("ts", F.col("ts").cast("bigint")), *[c for c in made.rows.columns if c != "ts"])


def per_node(spark, folder):
    """One series per event type, with the user id's last digit as a second key."""
    events = table(spark, folder, "events")
    hourly = events.select(
        F.col("event_type").alias("node"), (F.col("user_id") % 3).alias("lane"),
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ts"), "value",
    ).groupBy("node", "lane", "ts").agg(F.count(F.lit(1)).alias("arrivals"), F.avg("value").alias("avg_wait"))
    found = bucket_interval(hourly, series=["node", "lane"])
    made = series_table(
        hourly, lookback="3d", horizon="1d", lags=("1d", "2d"), rolling=("3d",), columns=["arrivals", "avg_wait"],
        series=["node", "lane"], interval=found, rows_per_block=split_block(found.rows), split=True,
    )
    out = rounded(made.rows.withColumn("ts", F.col("ts").cast("bigint")), *[c for c in made.rows.columns if c not in ("node", "lane", "ts")])
    return out


def spacing(spark, folder):
    found = bucket_interval(snapshots(spark, folder))
    return snapshots(spark, folder).agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(found.seconds).alias("seconds"), F.lit(found.regular).alias("regular")
    )


LONG = 500


def long_frames(spark, folder):
    """Rolling statistics over 500 rows of the event stream, in blocks; their cost does not depend on the frame."""
    values = table(spark, folder, "events").select(F.col("event_id").cast("double").alias("ts"), "value")
    rows = values.count()
    ready = prepared(values, None, LONG, 0, rows, max(LONG, split_block(rows)))
    w = ready.window
    built = with_running_sums(ready, {"value": LONG}).select(
        F.round(rolling_mean("value", w, LONG), 6).alias("mean"), F.round(rolling_std("value", w, LONG), 6).alias("std"),
        F.round(trend("value", w, LONG) + OFF_TIES, 6).alias("slope"),
    )
    return built.finish().select(F.col("ts").cast("bigint").alias("ts"), "mean", "std", "slope")


def uneven(spark, folder):
    """Days with events per node and lane: the smallest first gap, and how many gaps differ from it."""
    days = table(spark, folder, "events").select(
        F.col("event_type").alias("node"), (F.col("user_id") % 50).alias("lane"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ts"),
    ).distinct()
    found = bucket_interval(days, series=["node", "lane"])
    return days.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(found.seconds).alias("seconds"), F.lit(found.irregular).cast("bigint").alias("irregular"))


def ratios(spark, folder):
    sn = snapshots(spark, folder)
    for n in NODES:
        sn = sn.withColumn(f"n_{n}_util", F.try_divide(f"n_{n}_queue", "arrivals"))
    return sn.select(
        "ts", F.round(queue_to_busy(), 6).alias("queue_to_busy_ratio"),
        F.round(imbalance(node_columns(sn.columns, "queue")), 6).alias("queue_imbalance"),
        F.round(imbalance(node_columns(sn.columns, "util")), 6).alias("util_imbalance"),
        F.round(guarded("in_queue", "arrivals", 0.0), 6).alias("queued_share"),
    )


def relative(spark, folder):
    """A value against its mean over the whole table (a scalar subquery)."""
    sn = snapshots(spark, folder)
    mean = sn.agg(F.avg("in_queue").alias("m")).select("m").scalar()
    return sn.select("ts", F.round(F.try_divide(F.col("in_queue"), mean), 6).alias("queue_relative"))


def stored_features(spark, folder):
    store = FeatureStore()
    for name, source, kind, parameters in (
        ("wait_lag", "avg_wait", "lag", {"duration": "2h"}),
        ("wait_mean", "avg_wait", "rolling_mean", {"duration": "3h"}),
        ("wait_std", "avg_wait", "rolling_std", {"duration": "3h"}),
        ("wait_slope", "avg_wait", "trend", {"duration": "3h"}),
        ("queued_per_busy", "in_queue", "ratio", {"denominator": "busy", "otherwise": -1.0}),
        ("doubled", "arrivals", "derived", {"expression": "arrivals * 2.0D"}),
    ):
        store.register(FeatureDefinition(name, source, kind, parameters))
    names = [d.name for d in store.definitions()]
    sn = snapshots(spark, folder)
    found = bucket_interval(sn)
    ready = prepared(sn, None, store.reach(names, found.seconds), 0, found.rows, split_block(found.rows))
    out = store.added(ready, names, found.seconds).finish()
    out = out.withColumn("wait_slope", F.col("wait_slope") + OFF_TIES)
    return rounded(out.select(F.col("ts").cast("bigint").alias("ts"), *names), *names)


def full(value: str, column: str, k: int, part: str = "") -> str:
    frame = f"({part} ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {k} THEN {value} OVER {frame} END"


def feature_sql(columns: list[str], lags: dict[str, int], rolls: dict[str, int], back: int, ahead: int, target: str, part: str = "") -> list[str]:
    out = []
    for c in columns:
        for d, k in lags.items():
            out.append(f"CAST(lag({c}, {k}) OVER ({part} ORDER BY ts) AS DOUBLE) AS {c}_lag_{d}")
        for d, k in rolls.items():
            out.append(f"{full(f'avg({c})', c, k, part)} AS {c}_rmean_{d}")
            out.append(f"{full(f'stddev_samp({c})', c, k, part)} AS {c}_rstd_{d}")
        out.append(f"{full(f'regr_slope({c}, rn)', c, back, part)} AS {c}_trend")
    out.append(f"lead({target}, {ahead}) OVER ({part} ORDER BY ts) AS {target}_target")
    return out


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


QUEUES = [f"n_{n}_queue" for n in NODES]
SOURCES = ["arrivals", "in_queue", "busy", *QUEUES]
LAGS, ROLLS = {"1h": 1, "2h": 2, "4h": 4}, {"2h": 2, "4h": 4}
BUILT = [*[f"{c}_{s}" for c in SOURCES for s in (*[f"lag_{d}" for d in LAGS], *[f"{r}_{d}" for d in ROLLS for r in ("rmean", "rstd")], "trend")], "avg_wait_target"]
IMBALANCE = f"CASE WHEN ({' + '.join(QUEUES)}) > 0 THEN greatest({', '.join(QUEUES)}) / (({' + '.join(QUEUES)}) / 5e0) ELSE 1e0 END"
UTILS = [f"(n_{n}_queue / nullif(arrivals, 0))" for n in NODES]
WHOLE = f"""WITH {SNAPSHOTS}, nu AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM sn),
        fe AS (SELECT ts, {', '.join(feature_sql(SOURCES, LAGS, ROLLS, 4, 1, 'avg_wait'))},
          CASE WHEN busy > 0 THEN in_queue / busy ELSE 0e0 END AS queue_to_busy_ratio, {IMBALANCE} AS queue_imbalance FROM nu)
        SELECT ts, {rounded_sql([*BUILT, 'queue_to_busy_ratio', 'queue_imbalance'])}, round(avg_wait_target, 6) AS label
        FROM fe WHERE {' AND '.join(f'{n} IS NOT NULL' for n in BUILT)}"""
NODE_BUILT = [*[f"{c}_{s}" for c in ("arrivals",) for s in ("lag_1d", "lag_2d", "rmean_3d", "rstd_3d", "trend")], "avg_wait_target"]
PER_NODE = f"""WITH da AS (SELECT event_type AS node, user_id % 3 AS lane, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS ts,
            count(*) AS arrivals, avg(value) AS avg_wait FROM events GROUP BY ALL),
        nu AS (SELECT *, row_number() OVER (PARTITION BY node, lane ORDER BY ts) AS rn FROM da),
        fe AS (SELECT node, lane, ts, {', '.join(feature_sql(['arrivals'], {'1d': 1, '2d': 2}, {'3d': 3}, 3, 1, 'avg_wait', 'PARTITION BY node, lane'))} FROM nu)
        SELECT node, lane, ts, {rounded_sql(NODE_BUILT)}, round(avg_wait_target, 6) AS label FROM fe
        WHERE {' AND '.join(f'{n} IS NOT NULL' for n in NODE_BUILT)}"""


def plain(columns: str) -> str:
    return f"WITH {SNAPSHOTS}, nu AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM sn) SELECT ts, {columns} FROM nu"


ENTRIES = [
    Entry("series_snapshots", lambda s, f: rounded(snapshots(s, f), "avg_wait"), f"""WITH {SNAPSHOTS}
        SELECT ts, bucket_idx, arrivals, n_click_queue, n_error_queue, n_purchase_queue, n_signup_queue, n_view_queue,
          in_queue, busy, round(avg_wait, 6) AS avg_wait FROM sn"""),
    Entry("series_interval", spacing, f"""WITH {SNAPSHOTS}
        SELECT count(*) AS rows, CAST((SELECT min(ts) FROM sn WHERE ts > (SELECT min(ts) FROM sn)) - min(ts) AS DOUBLE) AS seconds, true AS regular FROM sn"""),
    Entry("series_interval_uneven", uneven, """
        WITH da AS (SELECT DISTINCT event_type AS node, user_id % 50 AS lane, epoch(date_trunc('day', ts)) AS t FROM events),
        ga AS (SELECT t - lag(t) OVER w AS gap, row_number() OVER w AS k FROM da WINDOW w AS (PARTITION BY node, lane ORDER BY t))
        SELECT (SELECT count(*) FROM da) AS rows, CAST((SELECT min(gap) FROM ga WHERE k = 2) AS DOUBLE) AS seconds,
          (SELECT count(*) FROM ga WHERE gap <> (SELECT min(gap) FROM ga WHERE k = 2)) AS irregular"""),
    Entry("series_long_frames", long_frames, f"""
        WITH nu AS (SELECT event_id AS ts, value, row_number() OVER (ORDER BY event_id) AS rn FROM events)
        SELECT ts, round({full('avg(value)', 'value', LONG)}, 6) AS mean, round({full('stddev_samp(value)', 'value', LONG)}, 6) AS std,
          round({full('regr_slope(value, rn)', 'value', LONG)} + {OFF_TIES}, 6) AS slope FROM nu"""),
    Entry("series_lag", windowed(lambda w: {"wait_lag_1": lag("avg_wait", w, 1), "wait_lag_4": lag("avg_wait", w, 4)}, before=4),
          plain("round(lag(avg_wait, 1) OVER (ORDER BY ts), 6) AS wait_lag_1, round(lag(avg_wait, 4) OVER (ORDER BY ts), 6) AS wait_lag_4")),
    Entry("series_rolling_mean", windowed(lambda w: {"wait_rmean": rolling_mean("avg_wait", w, 4)}, before=4),
          plain(f"round({full('avg(avg_wait)', 'avg_wait', 4)}, 6) AS wait_rmean")),
    Entry("series_rolling_std", windowed(lambda w: {"wait_rstd": rolling_std("avg_wait", w, 4)}, before=4),
          plain(f"round({full('stddev_samp(avg_wait)', 'avg_wait', 4)}, 6) AS wait_rstd")),
    Entry("series_trend", windowed(lambda w: {"wait_trend": trend("avg_wait", w, 6) + OFF_TIES}, before=6),
          plain(f"round({full('regr_slope(avg_wait, rn)', 'avg_wait', 6)} + {OFF_TIES}, 6) AS wait_trend")),
    Entry("series_target", windowed(lambda w: {"wait_ahead": target_ahead("avg_wait", w, 3)}, after=3),
          plain("round(lead(avg_wait, 3) OVER (ORDER BY ts), 6) AS wait_ahead")),
    Entry("series_delta", windowed(lambda w: {"wait_delta": F.col("avg_wait") - lag("avg_wait", w, 2)}, before=2),
          plain("round(avg_wait - lag(avg_wait, 2) OVER (ORDER BY ts), 6) AS wait_delta")),
    Entry("series_ratios", ratios, f"""WITH {SNAPSHOTS}
        SELECT ts, round(CASE WHEN busy > 0 THEN in_queue / busy ELSE 0e0 END, 6) AS queue_to_busy_ratio,
          round({IMBALANCE}, 6) AS queue_imbalance,
          round(CASE WHEN arrivals > 0 THEN greatest({', '.join(UTILS)}) / (({' + '.join(UTILS)}) / 5e0) ELSE 1e0 END, 6) AS util_imbalance,
          round(CASE WHEN arrivals > 0 THEN in_queue / arrivals ELSE 0e0 END, 6) AS queued_share FROM sn"""),
    Entry("series_relative", relative, f"WITH {SNAPSHOTS} SELECT ts, round(in_queue / (SELECT avg(in_queue) FROM sn), 6) AS queue_relative FROM sn"),
    Entry("series_features", whole, WHOLE),
    Entry("series_features_in_blocks", lambda s, f: whole(s, f, True), WHOLE),
    Entry("series_features_per_series", per_node, PER_NODE),
    Entry("series_defined_features", stored_features, plain(
        f"round(lag(avg_wait, 2) OVER (ORDER BY ts), 6) AS wait_lag, round({full('avg(avg_wait)', 'avg_wait', 3)}, 6) AS wait_mean, "
        f"round({full('stddev_samp(avg_wait)', 'avg_wait', 3)}, 6) AS wait_std, round({full('regr_slope(avg_wait, rn)', 'avg_wait', 3)} + {OFF_TIES}, 6) AS wait_slope, "
        "round(CASE WHEN busy > 0 THEN in_queue / busy ELSE -1e0 END, 6) AS queued_per_busy, arrivals * 2e0 AS doubled")),
]
