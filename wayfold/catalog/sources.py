"""Readers, renaming, the dataset store and history."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.catalog.entry import JOURNEYS, SNAPSHOTS, Entry, plain_journeys, r6, rounded
from wayfold.model import Dataset
from wayfold.operators.discovery import targets_from_categories
from wayfold.session import cut_lineage, fresh_path
from wayfold.sources.event_tables import snapshots, table
from wayfold.sources.files import load, load_csv, load_parquet
from wayfold.sources.layered_json import snapshots_layer, trajectories_layer
from wayfold.sources.store import DatasetStore, content_hash, latest, preview

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
SERIES_TABLES = ("events", "orders", "lineitem")


def csv_round(spark, folder):
    path = fresh_path(spark, "csv")
    table(spark, folder, "customer").write.option("header", True).csv(path)
    read = load_csv(spark, path).trajectories
    return read.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal", "c_mktsegment",
    )


def parquet_layers(spark, folder):
    found = None
    for name in TABLES:
        dataset = load_parquet(spark, f"{folder}/{name}.parquet")
        (layer, df), = dataset.layers().items()
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(layer).alias("layer"), "rows")
        found = part if found is None else found.unionByName(part)
    return found


def by_suffix(spark, folder):
    df = load(spark, f"{folder}/labels.parquet").layers()["trajectories"]
    return df.select(F.col("doc_id"), F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))


def snapshot_names(spark, folder):
    raw = snapshots(spark, folder).select(
        F.col("ts").alias("timestamp"), F.col("bucket_idx").alias("bucket_index"),
        F.col("in_queue").alias("sys_total_in_queue"), F.col("busy").alias("sys_total_busy"),
        F.col("avg_wait").alias("sys_avg_wait_time"), F.col("arrivals").alias("sys_cumulative_arrivals"),
        *[F.col(f"n_{n}_queue").alias(f"node_{n}_queue") for n in ("click", "view")],
        (F.col("busy") / 10).alias("resource_desk_utilization"), F.lit(10).alias("node_click_colour"),
    )
    return rounded(snapshots_layer(raw), "avg_wait", "r_desk_util")


def trajectory_names(spark, folder):
    tr = plain_journeys(spark, folder)
    raw = tr.select(
        F.col("eid").alias("entity_id"), F.col("step").alias("step_index"), F.col("node").alias("node_name"),
        F.col("done").alias("episode_done"), F.lit(3600).cast("bigint").alias("sla_visit_limit"), F.lit("x").alias("colour"),
        F.struct(
            r6("s_elapsed").alias("entity_elapsed_time"), r6("s_cum_wait").alias("entity_cumulative_wait"),
            F.col("s_sys_util").alias("sys_utilization"), F.col("s_node_util").alias("resource_desk_one_utilization"),
            F.col("s_node_avg_queue").alias("attr_size"), F.lit(1).alias("shape"),
        ).alias("state"),
        F.struct(r6(-F.col("wait")).alias("time_penalty"), F.lit(0.0).alias("glory")).alias("reward"),
        F.struct(F.col("s_steps_done").alias("entity_steps_completed")).alias("next_state"),
    )
    return trajectories_layer(raw)


def exported(spark, folder):
    """Journeys written as small JSON documents (one per 40 seconds and key slice), then loaded like any export."""
    tr = plain_journeys(spark, folder)
    record = F.struct(
        F.col("eid").alias("entity_id"), F.col("step").alias("step_index"), F.col("node").alias("node_name"),
        F.col("done").alias("episode_done"), F.struct(r6("s_elapsed").alias("entity_elapsed_time")).alias("state"),
        F.struct(r6(-F.col("wait")).alias("time_penalty")).alias("reward"),
    )
    documents = (
        tr.groupBy(F.pmod(F.hash("eid"), F.lit(64)).alias("part"), F.floor(F.col("t_enter") / 40).alias("stretch"))
        .agg(F.collect_list(record).alias("trajectories"))
        .select(F.struct(F.lit("1.0").alias("version")).alias("metadata"), "trajectories")
    )
    path = fresh_path(spark, "export") + ".json"
    documents.write.json(path)
    return load(spark, path, document_per_line=True).trajectories


def mapped(spark, folder):
    dataset = load_parquet(spark, f"{folder}/supplier.parquet", {"s_suppkey": "eid", "s_acctbal": "s_cum_cost"})
    return dataset.trajectories.select("eid", "s_name", "s_cum_cost", F.col("s_nationkey").cast("bigint").alias("s_nationkey"))


def registered(spark, folder):
    store = DatasetStore(spark, fresh_path(spark, "store"))
    dataset_id = store.register(Dataset(snapshots(spark, folder), plain_journeys(spark, folder)), "events")
    if not store.exists(dataset_id):
        raise RuntimeError("a registered dataset must exist")
    layer = store.read(dataset_id, "trajectories")
    return rounded(layer.select("eid", "step", "node", "done", "wait", "total_time"), "wait", "total_time")


def sorted_files(spark, folder):
    """Registered snapshots lie in files whose ranges of time do not overlap."""
    store = DatasetStore(spark, fresh_path(spark, "store"))
    layer = store.read(store.register(Dataset(snapshots(spark, folder), None), "series", exact=False), "snapshots")
    rows = layer.select(F.col("_metadata.file_path").alias("file"), "ts")
    files = rows.groupBy("file").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n"))
    follows = F.lag("high").over(Window.orderBy("low")) < F.col("low")
    return files.select("n", F.coalesce(follows, F.lit(True)).alias("apart")).agg(F.sum("n").alias("rows"), F.bool_and("apart").alias("apart"))


def record_list(spark, folder):
    store = DatasetStore(spark, fresh_path(spark, "store"))
    for name in ("customer", "labels", "orders"):
        store.register(load_parquet(spark, f"{folder}/{name}.parquet"), name)
    store.delete(store.datasets().where("name = 'labels'").first()["id"])
    return store.datasets().select("name", F.inline(F.map_entries("row_counts"))).select(
        "name", F.col("key").alias("layer"), F.col("value").alias("rows")
    )


def first_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    rows, total = preview(orders, 100, ["o_orderkey"])
    return rows.withColumn("total_rows", F.lit(total).cast("bigint"))


def history(spark, folder):
    records = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("experiment_id"), F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("score"), "event_id",
    )
    return latest(records, "experiment_id", "event_id", ["status", "score"]).orderBy(F.desc("event_id"))


def fingerprint(spark, folder):
    names = ("customer", "orders", "lineitem")
    rows = [(n, content_hash(table(spark, folder, n))) for n in names]
    return spark.createDataFrame(rows, "name string, content_hash string")


def fingerprint_rules(spark, folder):
    """The fingerprint does not depend on the order of rows, and changes with a single value."""
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    changed = events.withColumn("value", F.when(F.col("event_id") == 17, F.col("value") + 1).otherwise(F.col("value")))
    own = content_hash(events)
    told = (own == content_hash(events.repartition(7, "event_type")), own != content_hash(changed))
    return spark.createDataFrame([told], "same_in_any_order boolean, changes_with_a_value boolean")


def as_one_document(path, layers):
    """Writes a single document over many lines: many tasks make the lines, one task passes them on in the order it reads them, sorting and holding none."""
    parts, firsts, place = [], [], 0
    for k, (name, rows) in enumerate(layers.items()):
        lines = cut_lineage(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), "lines")
        opening = ('{"metadata": {"version": "2.0"}, ' if k == 0 else "], ") + f'"{name}": ['
        parts += [edge(rows.sparkSession, place, opening), lines.withColumn("at", F.lit(None).cast("bigint"))]
        firsts.append(place + 1)
        place += 1 + lines.count()
    parts.append(edge(parts[0].sparkSession, place, "]}"))
    # In one partition the numbers are the places of the lines.
    line = functools.reduce(DataFrame.unionByName, parts).coalesce(1).withColumn("place", F.monotonically_increasing_id())
    text = (
        F.when(F.col("at") != F.col("place"), F.raise_error(F.lit("the parts of the document were not read in order")))
        .when(F.col("at").isNotNull() | F.col("place").isin(firsts), F.col("value"))
        .otherwise(F.concat(F.lit(", "), "value"))
    )
    line.select(text.alias("value")).write.text(path)


def edge(spark, place, text):
    """A line between layers, which must come at a place; from a file like all others, so that it is read where it stands."""
    return cut_lineage(spark.createDataFrame([(text, place)], "value string, at bigint").coalesce(1), "edge")


def one_document(layer):
    """Whole layers in one document, nodes with underscores in their names, read by many tasks."""
    def run(spark, folder):
        states = snapshots(spark, folder).select(
            F.col("ts").alias("timestamp"), F.col("bucket_idx").alias("bucket_index"), F.col("arrivals").alias("sys_cumulative_arrivals"),
            F.col("n_view_queue").alias("node_front_desk_queue"), F.lit("}x{").alias("colour"),
        )
        journeys = plain_journeys(spark, folder).select(
            F.col("eid").alias("entity_id"), F.col("step").alias("step_index"), F.col("node").alias("node_name"), F.col("done").alias("episode_done"),
        )
        path = fresh_path(spark, "document") + ".json"
        as_one_document(path, {"state_snapshots": states, "trajectories": journeys})
        return load(spark, path, split=True).layers()[layer]
    return run


def many_documents(layer):
    """Both layers of the whole tables: a document for each run of buckets and for each slice of entities and time, so that Spark spreads them."""
    def run(spark, folder):
        state = F.struct(
            F.col("ts").alias("timestamp"), F.col("bucket_idx").alias("bucket_index"), F.col("arrivals").alias("sys_cumulative_arrivals"),
            F.col("n_view_queue").alias("node_front_desk_queue"), F.lit("x").alias("colour"),
        )
        step = F.struct(F.col("eid").alias("entity_id"), F.col("step").alias("step_index"), F.col("node").alias("node_name"), F.col("done").alias("episode_done"))
        states = snapshots(spark, folder).groupBy(F.floor(F.col("bucket_idx") / 64).alias("part")).agg(F.collect_list(state).alias("state_snapshots"))
        journeys = plain_journeys(spark, folder).groupBy(
            F.pmod(F.hash("eid"), F.lit(64)).alias("part"), F.floor(F.col("t_enter") / 40).alias("stretch")
        ).agg(F.collect_list(step).alias("trajectories"))
        documents = states.select("state_snapshots").unionByName(journeys.select("trajectories"), allowMissingColumns=True)
        path = fresh_path(spark, "documents") + ".json"
        documents.withColumn("metadata", F.struct(F.lit("2.0").alias("version"))).write.json(path)
        return load(spark, path, document_per_line=True).layers()[layer]
    return run


def varying_state(tr):
    """Journeys as raw records: the state's fields differ from row to row, and every third row has none of them."""
    pairs = (
        ("entity_elapsed_time", r6("s_elapsed"), F.col("step") % 3 == 0),
        ("entity_cumulative_wait", r6("s_cum_wait"), F.col("step") % 3 == 1),
        ("resource_desk_one_utilization", F.col("s_node_util").cast("double"), F.col("done")),
        ("attr_size", F.col("s_node_avg_queue").cast("double"), F.col("step") % 2 == 0),
        ("shape", F.lit(1.0), F.col("step") % 2 == 1),
    )
    entries = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(n), v)) for n, v, has in pairs]))
    return tr.select(
        F.col("eid").alias("entity_id"), F.col("step").alias("step_index"), F.col("node").alias("node_name"),
        F.map_from_entries(entries).alias("state"),
        F.when(F.col("done"), F.create_map(F.lit("time_penalty"), r6(-F.col("wait")))).alias("reward"),
    )


def map_records(spark, folder):
    """State and reward as maps whose keys vary by row."""
    return trajectories_layer(varying_state(plain_journeys(spark, folder)))


def variant_records(spark, folder):
    """The same records as JSON documents, read as variants: no schema is given or inferred."""
    rows = varying_state(plain_journeys(spark, folder))
    documents = rows.groupBy(F.pmod(F.hash("entity_id"), F.lit(64)).alias("part"), F.floor(F.col("step_index") / 64).alias("stretch")).agg(
        F.collect_list(F.struct(*rows.columns)).alias("trajectories")
    )
    path = fresh_path(spark, "varying") + ".json"
    documents.select("trajectories").write.json(path)
    return load(spark, path, document_per_line=True, varying=True).trajectories


def map_fingerprint(spark, folder):
    """Maps with the same entries in another order are the same rows; another value makes others."""
    maps = table(spark, folder, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("m"))
    turned = maps.select("event_id", F.map_from_entries(F.reverse(F.map_entries("m"))).alias("m"))
    changed = maps.select("event_id", F.map_filter("m", lambda k, v: ~((k == "user") & (v == "7"))).alias("m"))
    own = content_hash(maps)
    return spark.createDataFrame([(own == content_hash(turned), own == content_hash(changed))], "same_in_any_order boolean, same_without_an_entry boolean")


def stored_categories(spark, folder):
    """Customers' names: one category each, far more than a profile row lists."""
    store = DatasetStore(spark, fresh_path(spark, "store"))
    lines = table(spark, folder, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("status"), "l_quantity")
    dataset_id = store.register(Dataset(None, lines), "orders", exact=False)
    return targets_from_categories(store.categories(dataset_id, "trajectories"))


VARYING = f"""WITH {JOURNEYS}
        SELECT eid, step, node, CASE WHEN step % 3 = 0 THEN round(s_elapsed, 6) END AS s_elapsed, CASE WHEN step % 3 = 1 THEN round(s_cum_wait, 6) END AS s_cum_wait,
          CASE WHEN done THEN CAST(s_node_util AS DOUBLE) END AS s_r_desk_one_util, CASE WHEN step % 2 = 0 THEN CAST(s_node_avg_queue AS DOUBLE) END AS s_attr_size,
          CASE WHEN done THEN round(-wait, 6) END AS rw_time_penalty FROM tr"""

ENTRIES = [
    Entry("source_map_records", map_records, VARYING),
    Entry("source_variant_records", variant_records, VARYING),
    Entry("store_map_fingerprint", map_fingerprint, """
        SELECT true AS same_in_any_order, count(*) FILTER (user_id = 7) = 0 AS same_without_an_entry FROM events"""),
    Entry("source_csv", csv_round, """
        SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"""),
    Entry("source_parquet_layers", parquet_layers, " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{'snapshots' if n in SERIES_TABLES else 'trajectories'}' AS layer, count(*) AS rows FROM {n}"
        for n in TABLES)),
    Entry("source_by_suffix", by_suffix, """
        SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels"""),
    Entry("source_snapshot_names", snapshot_names, f"""WITH {SNAPSHOTS}
        SELECT ts, bucket_idx, in_queue, busy, round(avg_wait, 6) AS avg_wait, arrivals AS cum_arrivals,
          n_click_queue, n_view_queue, round(busy / 10, 6) AS r_desk_util FROM sn"""),
    Entry("source_trajectory_names", trajectory_names, f"""WITH {JOURNEYS}
        SELECT eid, step, node, done, CAST(3600 AS BIGINT) AS sla_visit_limit, round(s_elapsed, 6) AS s_elapsed,
          round(s_cum_wait, 6) AS s_cum_wait, s_sys_util, s_node_util AS s_r_desk_one_util,
          s_node_avg_queue AS s_attr_size, round(-wait, 6) AS rw_time_penalty, s_steps_done AS ns_steps_done FROM tr"""),
    Entry("source_layered_json", exported, f"""WITH {JOURNEYS}
        SELECT eid, step, node, done, round(s_elapsed, 6) AS s_elapsed, round(-wait, 6) AS rw_time_penalty FROM tr"""),
    Entry("source_mapped_names", mapped, """
        SELECT s_suppkey AS eid, s_name, s_acctbal AS s_cum_cost, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"""),
    Entry("store_register_read", registered, f"""WITH {JOURNEYS}
        SELECT eid, step, node, done, round(wait, 6) AS wait, round(total_time, 6) AS total_time FROM tr"""),
    Entry("store_sorted_files", sorted_files, f"WITH {SNAPSHOTS} SELECT count(*) AS rows, true AS apart FROM sn"),
    Entry("store_records", record_list, """
        SELECT 'customer' AS name, 'trajectories' AS layer, count(*) AS rows FROM customer
        UNION ALL SELECT 'orders', 'snapshots', count(*) FROM orders"""),
    Entry("store_preview", first_rows, """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total_rows
        FROM orders ORDER BY o_orderkey LIMIT 100"""),
    Entry("store_history", history, """
        SELECT CAST(user_id AS VARCHAR) AS experiment_id, arg_max(event_type, event_id) AS status,
          arg_max(value, event_id) FILTER (event_type = 'purchase') AS score, max(event_id) AS event_id
        FROM events GROUP BY user_id"""),
    Entry("store_content_hash", fingerprint),
    Entry("store_content_hash_rules", fingerprint_rules, "SELECT true AS same_in_any_order, true AS changes_with_a_value"),
    Entry("store_categories", stored_categories, """
        SELECT 'order ' || l_orderkey AS label, count(*) AS rows, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1"""),
    Entry("source_one_document_snapshots", one_document("snapshots"), f"""WITH {SNAPSHOTS}
        SELECT ts, bucket_idx, arrivals AS cum_arrivals, n_view_queue AS n_front_desk_queue FROM sn"""),
    Entry("source_one_document_trajectories", one_document("trajectories"), f"""WITH {JOURNEYS}
        SELECT eid, step, node, done FROM tr"""),
    Entry("source_documents_snapshots", many_documents("snapshots"), f"""WITH {SNAPSHOTS}
        SELECT ts, bucket_idx, arrivals AS cum_arrivals, n_view_queue AS n_front_desk_queue FROM sn"""),
    Entry("source_documents_trajectories", many_documents("trajectories"), f"""WITH {JOURNEYS}
        SELECT eid, step, node, done FROM tr"""),
]
