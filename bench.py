"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from wavecairn.session import local_session

HEADLINE = [
    "a5_crop", "d2_apply_montage", "d3_nearest_in_time", "e1_assign_windows", "e2_detector_features", "e4_band_energy",
    "e5_stat_features", "f1_robust_z", "g3_verify_events", "g5_cluster_annotations", "h3_roles", "i5_temporal_graph",
    "j2_diffuse", "k1_dtw_distance", "k2_dfa_exponent", "l2_wavelet_representation", "p1_detect", "p4_ensemble_detect",
    "p7_residual_detect",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from checks import QUERIES

    # One small query starts the workers; it is not timed.
    QUERIES["k1_dtw_distance"](spark, sf).limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
