"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from tablemend.plans.catalog import QUERIES
from tablemend.session import local_session

HEADLINE = [
    "truth_discovery_em",
    "truth_discovery",
    "learn_error_rate_by_source",
    "unit_correct",
    "char_bigram",
    "candidates_unblocked",
    "repair_typos",
    "impute",
    "accuracy",
    "link_map",
    "initial_link",
    "sweep_once",
    "normalize_tables",
    "repair_typos_short",
    "repair_typos_long",
    "joint_repair",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # session start-up is not measured
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline cleaning jobs, total seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
