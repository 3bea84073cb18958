"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the best of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ("where_num", "with_column", "agg_global", "group_multi", "revenue_by_nation", "order_limit", "distinct_first", "union_by", "diff_modified", "validate_rules", "csv_native_scan", "csv_roundtrip", "inner_join", "window_tumbling")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tabspark.queries import QUERIES
    from tabspark.session import get_session

    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
