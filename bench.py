"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from parapet.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: seconds for the runs of one query
BUDGET_S = float(os.environ.get("BENCH_BUDGET_S", "60"))
HEADLINE = (
    "E01_containment", "E03_far_band", "E06_setback_formula", "E13_light_ventilation_ratio", "E18_evaluate",
    "F17_far_readings", "M02_shrink_wall", "G01_chunk_clauses", "J11_plot_and_sector", "D05_within",
)


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-checkpoints-"))
    from parapet.catalog import QUERIES

    times = {}
    for name in HEADLINE:
        # one run to warm up, then the median of three; a long query is not repeated beyond its budget
        runs, begun = [], time.time()
        for i in range(4):
            start = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
            if i and time.time() - begun > BUDGET_S:
                break
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
