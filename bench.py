"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.plans.catalog import QUERIES  # noqa: E402
from pairloom.session import local_session  # noqa: E402

HEADLINE = (
    "J2_set_join_09",
    "J3_edit_join",
    "J4_self_set_join",
    "J1_contrastive_pairs",
    "A2_similarity_distribution",
    "A8_iqr_fences",
    "A14_many_partner_summary",
    "A16_pair_census",
    "A22_metric_means",
    "K2_nearest",
    "K5_distractors",
    "U5_merge_sources",
    "U6_fragment_comparison",
    "W4_number_duplicates",
    "X1_random",
    "X10_group_greedy",
    "X13_endpoint_split",
    "X14_leakage_repair",
    "D9_primary_type",
    "M5_stepwise_string",
    "Q1_task_tables",
    "E1_encode_once",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf}/labels.parquet").count()  # start-up is not part of a query
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
