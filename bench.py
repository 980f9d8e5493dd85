"""Times headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from normtext.plans import catalog
from normtext.session import build_session

HEADLINE = [
    "marker_hits", "category_strengths", "provision_determinacy", "qualifier_determinacy", "shortlist", "best_specimens",
    "marker_frequency", "near_misses", "retrieval_chunks", "length_profile", "co_occurrence", "hit_length_correlation",
    "pattern_scorecard", "change_signs", "version_drift", "passage_vectors", "drift_trajectory", "slot_comparisons",
    "first_absence", "ledger_settlement", "requirements", "requirement_drift", "cue_hits", "debate_direction",
    "decision_report", "axis_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
        spark__normtext__scanTasks=str(2 * int(cpus)),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    registered = catalog.queries()

    def timed(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timings = {name: timed(name) for name in HEADLINE}
    again = {name: timed(name) for name in HEADLINE}  # compiled code, warm files
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "second_run": again,
                "second_value": round(sum(again.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
