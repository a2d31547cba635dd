"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   test data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)

Each query runs to a sink that reads every row and keeps none. A first run
warms the JVM; the reported time is the best of three runs after it.
"""

from __future__ import annotations

import json
import os
import time

from fixtures.queries import queries
from wayfare.session import build_session

HEADLINE = [
    "user_journey",
    "user_journey_detailed",
    "session_summary",
    "journey_after_event",
    "product_time",
    "funnel_stats_by_funnel_session_category",
    "funnel_stats_grouping_sets",
    "second_page_counts",
    "last_page_after_event",
    "page_visits",
    "popular_interactions",
    "frequent_itemsets",
    "banner_report",
    "sentiment_recalibrated",
    "top_group_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "wayfare-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = _seconds(registered[name], spark, sf_dir)
        warm[name] = min(_seconds(registered[name], spark, sf_dir) for _ in range(3))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


def _seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


if __name__ == "__main__":
    main()
