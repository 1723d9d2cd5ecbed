"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regimeweave.plans import catalog  # noqa: E402
from regimeweave.session import get_session  # noqa: E402

HEADLINE = (
    "C4_audit",
    "C6_windows",
    "C10_scale_features",
    "D1_pairs",
    "E5_E6_E7_assign",
    "E10_davies_bouldin",
    "F2_event_value_quantiles",
    "F4_F5_memberships",
    "G4_temporal_balance",
    "H3_duplicate_members",
    "H8_split_embargo3",
    "I0_persistence_macro_f1",
    "I6_metrics",
    "I19_block_bootstrap",
    "I23_stride_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    catalog.flagship(spark, sf_dir).collect()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
