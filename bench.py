"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framespan.plans import checks  # noqa: E402
from framespan.session import local_session  # noqa: E402

HEADLINE = [
    "scene_window_summary",
    "assign_windows",
    "adjacent_overlap",
    "smoothed_series",
    "conf_mask",
    "threshold_depth",
    "sample_n",
    "irls_scale_eval",
    "irls_scale_points",
    "depth_metrics",
    "weighted_rollup",
    "topk_similar",
    "nms_pairs",
    "loop_ranges",
    "most_representative",
    "umeyama",
    "weighted_sim3",
    "alignment_error",
    "register_poses",
    "accumulate_sim3",
    "associate",
    "ate",
    "rpe",
    "merge_regions",
    "segment_pixels",
    "refine_depth",
    "components",
    "nearest",
    "nearest_line_items",
    "cloud_metrics",
    "icp",
    "unproject_world",
    "covisible_combined",
    "zbuffer",
    "observations",
    "assemble_frames",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "framespan-bench")
    names = sys.argv[1:] or HEADLINE
    # start the JVM code paths and one Python worker before timing
    checks.QUERIES["merge_windows"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    checks.QUERIES["umeyama"](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float | None] = {}
    for name in names:
        start = time.perf_counter()
        try:
            checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001
            print(f"{name}: {error}", file=sys.stderr)
            seconds[name] = None
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(s for s in seconds.values() if s is not None), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
