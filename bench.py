"""Times the headline queries; prints one JSON line.

Every query is run once to warm up and then timed; its result goes to Spark's ``noop`` sink,
so all rows and columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from helmtrace.checks import queries as Q
from helmtrace.session import local_session

HEADLINE = [
    "speed_jump",
    "beacon_on",
    "beacon_off",
    "course_heading",
    "loitering",
    "rendezvous",
    "identity_spoofing",
    "zone_violations",
    "detect_anomalies",
    "clean_positions",
    "clean_history",
    "dedup_pings",
    "recent_window",
    "nearest_ping",
    "vessel_stats",
    "type_anomaly_crosstab",
    "multi_anomaly_vessels",
    "movement_patterns",
    "segment_tracks",
    "motion_deltas",
    "track_features",
    "interpolate_tracks_linear",
    "training_sequences",
    "predict_tracks",
    "prediction_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores, int(cores))
    # Inputs that second-stage queries share are built, and timed, on their own, after the same
    # warm-up that the queries get.
    for made in (Q.make_anomalies(spark, sf_dir), *Q.make_sequences(spark, sf_dir)):
        made.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for label, make in (("stored_anomalies", Q.anoms), ("stored_sequences", Q.seqs)):
        start = time.perf_counter()
        make(spark, sf_dir).count()
        times[label] = round(time.perf_counter() - start, 3)
    for name in names:
        run = Q.QUERIES[name]
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spans = []
        for _ in range(repeats):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spans.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spans), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
