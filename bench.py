"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query seconds.

Each query is forced with the ``noop`` sink (full execution, nothing sent
to the driver).  Session start-up and an untimed warm-up (a scan of the
input and one flagship run on the smallest test scale, so JIT compilation
is not charged to the first timed query) are excluded.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.catalog import QUERIES  # noqa: E402
from faultline.session import build_session  # noqa: E402

HEADLINE = [
    "trigram_totals",            # A1: full trigram count
    "doc_trigram_counts",        # A2
    "outputs_over_10000",        # F1
    "trace_back_lines",          # L3: provenance backward
    "trace_forward_records",     # L5: provenance forward
    "part_test_matrix",          # D1
    "ddmin_lines",               # D2 on traced lines
    "ddmin_conjunction",         # D2 where complements decide
    "pipeline_traced_lines",     # E3 (flagship)
    "pipeline_traced_records",   # E1
    "pipeline_all_records",      # E2
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "spark.faultline.scanPartitions": str(2 * cpus)})
    spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).write.format("noop").mode("overwrite").save()
    warm_dir = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    if os.path.isdir(warm_dir):
        QUERIES["pipeline_traced_lines"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
