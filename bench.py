"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "l1_label_stats", "a0_condition_ctcf_summary", "b1_global_roi", "b3_annular_ring", "b5_voronoi",
    "b6_rolling_ball_r50", "b8_polynomial_surface", "q3_perimeter", "x5_normalise", "a1_mad_outliers",
    "a5_hierarchical_summary", "a9_iqr_removal", "t1_mann_whitney_u", "t4_kde_silverman",
    "m13_connected_components", "j5_candidate_links", "k2_optimal_links", "k4_lineage",
    "f5_position_scores", "z1_full_quantification",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from rasterlab.plans import catalog
    from rasterlab.session import build_session

    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers before timing
    catalog.QUERIES["l1_label_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["b6_rolling_ball"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
