"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f7_clean",
    "w1_segments",
    "w3_resample",
    "a1_grid_density",
    "a7_features",
    "a3_traffic_density",
    "m7_forecast",
    "a8_audit",
    "a5_stress",
    "j6_planes_in_cell",
    "m2_m3_anomalies",
    "w7_sample_flights",
    "q8_planes_at",
    "q9_live_planes",
]


def main() -> None:
    from vaportrail.session import get_session
    from workload.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # tables of a few megabytes: keep all cores busy
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the JVM's readers before the clock
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if name not in QUERIES or (only and name not in only):
            continue
        start = time.perf_counter()
        QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
