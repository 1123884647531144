"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from keelson.session import session

HEADLINE = (
    "repo_scorecard",
    "rescore_v1",
    "rescore_diff_v1_v2",
    "occurrence_scores",
    "top_contributors",
    "scan_count_partition",
    "advisory_rollup",
    "latest_scan_state",
    "dashboard_totals",
    "sibling_context",
    "dependency_page",
    "cosine_topk",
    "cvss_from_vector",
    "constraint_violations",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    more = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = session(f"local[{cpus}]", **more)
    spark.sparkContext.setLogLevel("ERROR")
    from keelson.catalog import QUERIES

    run = lambda name: QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # compiles and warms up; the measured runs follow
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
