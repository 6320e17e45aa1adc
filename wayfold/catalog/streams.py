"""Streams over the files of the event table; each reads what is there and stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.catalog.entry import SNAPSHOTS, Entry, rounded
from wayfold.catalog.learning import one_feature
from wayfold.plans.training import Trainer
from wayfold.session import fresh_path
from wayfold.sources.event_tables import table
from wayfold.streaming.closing import closable, run_to_end
from wayfold.streaming.scoring import append_to, scored_stream
from wayfold.streaming.snapshots import bucketed


def file_stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(spark, stream):
    path = fresh_path(spark, "stream")
    query = append_to(stream, path, path + "-state")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def closed_buckets(spark, folder):
    """All buckets of the events: the end of the stream is marked, so the last ones close as well."""
    events, path = file_stream(spark, folder, "events"), fresh_path(spark, "stream")
    stream = bucketed(closable(events, path + "-end"))
    run_to_end(stream, events.schema, path + "-end", path, path + "-state")
    return rounded(spark.read.schema(stream.schema).parquet(path), "avg_wait")


def scored(spark, folder):
    trainer = Trainer(one_feature(spark, folder), ["rmse"], "temporal", 3)
    fitted = trainer.fit(trainer.learners.get("linear"), trainer.rows, {"alpha": 50.0})
    customers = file_stream(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("arrivals"))
    found = drained(spark, scored_stream(customers, fitted, "ridge-1"))
    return found.select("c_custkey", F.round("predicted", 4).alias("predicted"), "model_id")


ENTRIES = [
    Entry("stream_snapshots", closed_buckets, f"""WITH {SNAPSHOTS}
        SELECT CAST(ts AS BIGINT) AS ts, arrivals, n_click_queue, n_error_queue, n_purchase_queue, n_signup_queue, n_view_queue,
          in_queue, busy, round(avg_wait, 6) AS avg_wait
        FROM filled"""),
    Entry("stream_scoring", scored, f"""WITH {SNAPSHOTS},
        mo AS (SELECT avg(arrivals) AS mx, avg(avg_wait) AS my, covar_pop(arrivals, avg_wait) * count(*) AS sxy,
               var_pop(arrivals) * count(*) AS sxx FROM sn)
        SELECT c_custkey, round(my + sxy / (sxx + 50e0) * (c_custkey % 40 - mx), 4) AS predicted, 'ridge-1' AS model_id FROM customer, mo"""),
]
