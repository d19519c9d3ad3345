"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, the better of $BENCH_REPEATS runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelens.catalog import all_queries  # noqa: E402
from tidelens.session import build_session  # noqa: E402

HEADLINE = (
    "fun01_funnel",
    "fun03_drop_off",
    "ses03_duration_distribution",
    "ses02_summary",
    "pat02_common_paths",
    "pat07_event_flow",
    "jou03_top_journeys",
    "jou07_friction",
    "att07_compare_models",
    "fea01_user_features",
    "fea09_rfm",
    "coh08_retention",
    "coh12_summary",
    "seg16_combined_users",
    "sco06_segment_summary",
    "sur03_kaplan_meier",
    "rea05_campaign_segments",
    "ano03_volume",
    "ano05_merchants",
    "mer01_metrics",
    "mer02_health",
    "pro02_performance",
    "sea02_top_searches",
    "del05_merchants",
    "tre03_popular_by_slot",
    "aff02_product_pairs",
    "aff03_association_rules",
    "rec05_item_similarity",
    "mlb08_churn_features",
    "dsh11_hourly_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["fun01_funnel"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(max(1, int(os.environ.get("BENCH_REPEATS", "2")))):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(min(runs), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
