"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchloom import catalog  # noqa: E402
from matchloom.session import get_spark  # noqa: E402

HEADLINE = [
    "ag_shot_grid", "ag_save_report", "ag_shot_report", "src_league", "ag_team_stats", "wn_score", "jn_assist_asof",
    "wn_speed", "wn_sprint", "wn_stamina", "ag_heat", "wn_role", "jn_nearest_ball", "wn_possession", "wn_pass",
    "ag_def_gap", "jn_lateral_defender", "jn_open_space", "al_6m", "jn_temporal_vote", "wn_ball_kalman",
    "vs_topk", "vs_match", "ag_prototype", "ag_jersey_vote", "mt_shot_edit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = get_spark("bench", cpus=cpus)
    qs = catalog.queries()
    for name in ("ag_tag_counts", "jn_nearest_ball", "jn_temporal_vote"):  # JVM warm-up and staging of the inputs
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline query seconds, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
