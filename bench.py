"""Time headline queries and print one JSON line.

Each query runs once to warm up and is then timed, with its result written to the
no-op sink so that nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fungo import catalog
from fungo.session import local_session

HEADLINE = [
    "rolling_prior_mean", "window_variants", "signed_streak", "expanding_season_mean", "calendar_range_sum", "asof_backward_join",
    "prior_season_join", "entity_fallback_join", "window_range_join", "weighted_mean", "multi_dim_report", "calibration_report",
    "feature_roi_report", "classification_metrics", "choose_side", "evaluate_candidate", "tune_thresholds", "bankroll_fold", "strategy_sweep",
    "slate_ranking", "blend_grid", "team_form", "starter_era", "bullpen_form", "impact_form", "feature_matrix", "matchup_rows",
    "event_pitcher_logs", "play_by_play_states", "quote_windows_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            t0 = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds, warm", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
