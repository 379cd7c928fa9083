"""Wall seconds of the headline queries, as one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query runs to a sink that keeps nothing; plan building and checkpoints inside count. One small
query warms the JVM up first. ``BENCH_ALL=1`` times every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keystride import catalog
from keystride.session import build_session

HEADLINE = [
    "c09_mix", "k01_gap_segments", "k04_kinematics", "w05_label_proportions", "w07_peer_percentiles", "w11_regulation_minutes", "w14_centred_mean",
    "w16_trailing_mean", "w18_signed_lead", "w20_rolling_line", "w23_relative_scores", "w24_kernel_modifier", "j01_as_of_label", "j05_k_nearest",
    "j07_actor_ball_distance", "e02_hysteresis_events", "e09_label_segments", "e13_possession_spans", "e15_carry_possession", "a01_reference_profiles",
    "a06_radius_calibration", "c01_pass_quality", "c03_sprint_recovery", "c10_report_windows", "s14_entity_resolve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("keystride-bench", f"local[{cpus}]", int(cpus))
    known = catalog.load()
    names = sys.argv[1:] or (list(known) if os.environ.get("BENCH_ALL") else HEADLINE)
    known["w17_running_sums"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for n in names:
        t = time.perf_counter()
        known[n][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
