"""Time the headline queries and print one JSON line.

Every query runs to completion into a no-op sink: once untimed (compilation, worker
start), then once timed, plan building and eager steps included.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rallyframe.session import build_session  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

HEADLINE = [
    "state_game_points",
    "state_games_sets",
    "state_lag_set_start",
    "game_match_winner",
    "serve_return_stats",
    "player_dimension",
    "star_join_filtered",
    "star_join_results",
    "point_model_columns",
    "point_importance",
    "clutch_by_match",
    "consistency_and_clutch",
    "pressure_rankings",
    "player_deltas",
    "unlikely_results",
    "score_summary",
    "top_swings",
    "top_upsets",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name][0](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
