"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads,
``BENCH_RUNS`` how many timed runs follow one warm-up (the median counts).
Results go to the ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.catalog import catalog  # noqa: E402
from cadenza.session import build_session  # noqa: E402

HEADLINE = (
    "ods_decode_roundtrip", "user_log_clean", "login_events", "song_play_wide",
    "song_hot_10s", "song_hot_1h", "song_hot_from_ods_1h", "singer_hot_10s", "singer_hot_1h",
    "song_hot_latest_top10", "geo_region_enrich", "region_login_1h", "machine_consume_wide",
    "region_revenue_1d", "cdc_latest_state", "cdc_route_counts", "cdc_dimension_rows",
    "dim_clean", "ai_response_wide", "ai_overview_1d", "ai_intent_1d", "feedback_attribution",
    "intent_classify", "hot_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "cadenza-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        timed = []
        for run in range(runs + 1):
            start = time.perf_counter()
            catalog()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median seconds, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
