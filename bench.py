"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed around a forced action (a noop write of its result), so lazy
plans are fully executed; the figure is the median of $BENCH_RUNS runs (default 3).
The phases of the full binning (scan, fit, transform) and of the model run (binning,
forest) are given beside them.

The JVM is warmed first by running the same queries once on a small scale factor
($BENCH_WARMUP_DIR, default sf0.01): code generation and JIT are then paid before the
timed runs, as on a long-running cluster.  The first-query (cold) time is reported
separately as ``cold_full_bin``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["full_bin", "numeric_bin", "rebalance_replicate", "class_metrics", "rf_multiclass"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from flowbin.operators.binning import BinningModel
    from flowbin.plans.experiment import run_experiment
    from flowbin.plans.queries import QUERIES, flow
    from flowbin.session import ensure_checkpoint_dir, force, local_session

    spark = local_session("bench", partitions=int(cpus) * 2, cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    phases: dict[str, list[float]] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        phases.setdefault(name, []).append(time.perf_counter() - t0)
        return out

    def once(name: str, d: str) -> float:
        t0 = time.perf_counter()
        if name == "rf_multiclass":
            rows = run_experiment(flow(spark, d), binary=False, models=("rf",), prefixes=(18,), dataset=d).collect()
            phases.setdefault("rf_fit", []).append(sum(r["train_time"] for r in rows))
            phases.setdefault("rf_bin", []).append(rows[0]["bin_time"])
        elif name == "full_bin":
            f = flow(spark, d)
            model = timed("full_bin_fit", lambda: BinningModel.fit(f))
            timed("full_bin_transform", lambda: force(model.transform(f).select("uid", *model.feature_names())))
            model.release()
        else:
            force(QUERIES[name](spark, d))
        return time.perf_counter() - t0

    cold = once("full_bin", warm_dir)
    for name in HEADLINE:
        once(name, warm_dir)
    phases.clear()
    times = {name: [] for name in HEADLINE}
    for _ in range(runs):
        timed("scan", lambda: force(flow(spark, sf_dir)))
        for name in HEADLINE:
            times[name].append(once(name, sf_dir))
    mid = {k: round(statistics.median(v), 3) for k, v in times.items()}
    extra = {k: round(statistics.median(v), 3) for k, v in phases.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(mid.values()), 3), "unit": "sec",
        "queries": {**mid, **extra, "cold_full_bin": round(cold, 3)}, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus), "runs": runs, "warmup": warm_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
