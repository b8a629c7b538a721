"""Headline benchmark: wall time of the five headline plans.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``; one warm-up, then the median of 5 timed runs per
query.  Each run executes the whole plan into the no-op sink (every row is
produced; nothing is cached between runs).  ``queries`` holds execution
time of a built plan; building the DataFrame in Python (driver-side,
constant in data size) is reported apart in ``build_sec``, and
``end_to_end`` holds build + execution.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["metric_state", "batch_gate", "merge_state", "counter_echo", "asof_lookup"]
# Also timed, not part of ``value``: the whole write path from signed JSON
# request bodies (verify, decode, gate, fold), closest to the reference's
# batch-update benchmark.
EXTRA = ["ingest_state"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    from gaugeline.session import get_session
    from gaugeline.plans import QUERIES

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    events_rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    builds: dict[str, float] = {}
    # Warm-up of every plan before any timing (JIT, caches); the heavy extra
    # plan first so its garbage is not collected inside a headline timing.
    for name in EXTRA + HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE + EXTRA:
        b = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir)
            b.append(time.perf_counter() - t0)
        df = QUERIES[name](spark, sf_dir)

        def run():
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        times[name] = round(statistics.median(run() for _ in range(runs)), 4)
        builds[name] = round(statistics.median(b), 4)
    total = round(sum(times[k] for k in HEADLINE), 4)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_wall",
        "value": total,
        "unit": "sec",
        "queries": times,
        "build_sec": builds,
        "end_to_end": {k: round(times[k] + builds[k], 4) for k in times},
        "rows_per_sec": {k: round(events_rows / v) for k, v in times.items() if v > 0},
        "us_per_row": {k: round(v / events_rows * 1e6, 2) for k, v in times.items()},
        "headline": HEADLINE,
        "events_rows": events_rows,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
