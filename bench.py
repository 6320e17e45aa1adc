"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the number of local cores,
BENCH_ONLY (comma-separated) limits the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfold.catalog import entries  # noqa: E402
from wayfold.session import local_session  # noqa: E402

HEADLINE = (
    "journeys_from_events",
    "labels_delay_severity",
    "labels_sla_fixed",
    "entity_delayed_at_entry",
    "entity_delayed_all_steps",
    "series_features",
    "series_long_frames",
    "profile_journeys",
    "quality_duplicates",
    "gate_entity",
    "eval_regression",
    "eval_auc_one_vs_rest",
    "fold_stratified",
    "reward_columns",
    "trajectory_advantages",
    "replay_uniform",
    "stream_snapshots",
    "learn_experiment",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = entries()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.monotonic()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
