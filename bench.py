"""Times the headline queries: one JSON line. BENCH_SF_DIR: tables (sf0.1 by default); BENCH_CPUS: cores."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tidewheel.plans import catalog

HEADLINE = [
    "composite_summary", "current_membership", "membership_at", "inventory_at", "latest_snapshot", "changelog_page", "query_text_search", "model_summaries",
    "platform_resolution", "add_dedup", "port_connect_discriminated", "dependencies_name_fallback", "downstream_closure", "member_changed_fanout", "metadata_merge",
    "scan_reconcile", "sql_read_tables", "cron_english", "validate_sr_11_7", "validate_eu_ai_act", "validate_nist_ai_rmf", "investigate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run is warm
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        took[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
