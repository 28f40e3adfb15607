"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["override_counts_by_cell", "boundary_shifts", "gate_overrides", "ema_loudness", "noise_floor", "trend_energy",
            "hysteresis_bucket", "asof_reading", "emit_on_change", "throttle", "speech_ratio", "speech_segments",
            "corrected_emotion", "recommendations", "cluster_mass", "separation_score", "track_boundaries", "pool_candidates",
            "phase_summary", "latency_report", "room_state"]


def main() -> None:
    from pyspark.sql import SparkSession

    from ambientspark.plans import queries, views

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("ambientspark-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    start = time.perf_counter()
    for view in ("frames", "tracks", "labels", "evidence"):
        views.slab(spark, sf_dir, view)
    times = {"slab_fitting": round(time.perf_counter() - start, 3)}  # once per data set
    for name in (only.split(",") if only else HEADLINE):
        start = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    room_days = views.frames(spark, sf_dir).count() / 43_200
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": Path(sf_dir).name.removeprefix("sf")}
    if "room_state" in times:
        out["room_days_per_minute"] = round(room_days / times["room_state"] * 60, 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
