"""Headline-query benchmark: prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2).
Each query is executed in full with the ``noop`` sink (no collect), warm runs, best time kept.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tsengine.session import build_session  # noqa: E402

HEADLINE = [
    "w52_quick_features",
    "w50_engineer_past",
    "w50b_engineer_past_long_series",
    "w48_feature_contract_50",
    "w51_technical_indicators",
    "w10_w11_past_rolling",
    "p02_p08_clean_data",
    "j02_attach_indicators",
    "j03_attach_indicators_asof",
    "a01_price_summary",
    "a09_fold_metrics",
    "a12_walk_forward_summary",
    "m01_ols_walk_forward_d1",
    "t05_bars_from_ticks",
    "s06_s09_normalise_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(app="tsengine-bench")
    from tsengine.plans.registry import load_all
    reg = load_all()
    times: dict[str, float] = {}
    # JIT / codegen warm-up on a small query (not timed)
    reg["w52_quick_features"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        fn = reg[name].fn
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
