"""Time headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ringtide.queries import QUERIES

HEADLINE = [
    "tuning_curves", "mean_vector_length", "times_in_states", "seconds_since", "frames_in_states", "state_epochs",
    "behavior_interval_mask", "enforce_min_duration", "binned_speed", "quantiles", "find_bimodal_threshold",
    "decoding_metrics", "circular_r", "frame_spike_counts", "putative_matches", "select_partners_probability",
    "pairwise_correlations", "population_vector", "compute_kinematics", "find_turns", "split_recording",
    "align_frames_to_events", "decode_heading", "hd_significance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tuning_curves"](spark, sf_dir).count()  # start the workers and compile once
    seconds = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
