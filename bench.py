"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores). Every query is
executed in full and its rows are counted on the executors (``noop`` sink). ``store_summary``
writes the stored packet base, which ``tensor_pack`` then reads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "packet_fields_unified", "packet_ordinals", "flow_grouping", "flow_total_packets", "cross_capture_dedup",
    "cut_packet_pct", "cut_time_abs", "cut_packet_abs", "cut_grid", "early_flow_features", "flow_features_full",
    "feature_cut_grid", "label_rules_first", "label_registry_exact", "label_nearest", "fuzzy_one_to_one",
    "exclusion_by_length", "day_label_mix", "feature_quality", "claim_audit", "class_cap", "stratified_split",
    "mask_strict", "ipv4_checksum", "store_summary", "tensor_pack", "per_class_metrics", "seed_aggregate",
]


def main() -> None:
    from packetloom.catalog.queries import QUERIES
    from packetloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("flow_grouping")  # start the Python workers and the code cache once
    took = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
