"""Time the headline queries at one scale factor and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from priorwise.plans.catalog import REGISTRY  # noqa: E402
from priorwise.session import local_session  # noqa: E402

HEADLINE = [
    "c01_game_team_summary",
    "d05_league_priors",
    "d09_point_in_time_game_features",
    "d16_shifted_rolling",
    "d17_rushing_ratio_features",
    "e07_roster_continuity",
    "d12_d13_elo_ratings",
    "f01_build_consensus",
    "f06_edge_table",
    "e11_attach_consensus",
    "f11_market_power_ratings",
    "g05_h08_prequential_market_blend",
    "h02_split_metrics",
    "h10_aggregate_report",
]

#: Model jobs, timed beside the headline queries and not part of their total.
MODELS = ["g01_walk_forward_ridge", "h12_feature_group_ablation", "g13_learned_in_two_runs"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    asked = os.environ.get("BENCH_QUERIES", "").split()
    names = asked or HEADLINE
    spark = local_session(cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, models = {}, {}
    for into, group in ((seconds, names), (models, [] if asked else MODELS)):
        for name in group:
            began = time.time()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - began, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "model_queries": models, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
