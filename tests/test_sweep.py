"""The sweep: committed results, restarts, one scoring pass a task, tables by task."""

import tempfile

import pytest
from pyspark.sql import functions as F

from flowbin.operators import models as M
from flowbin.operators.metrics import confusion
from flowbin.plans import experiment
from flowbin.plans.experiment import distinct_state, prepare_tasks, run_experiment
from flowbin.sources.results import RESULTS, ResultsSink

SETTINGS = dict(binary=True, models=("rf",), prefixes=(9, 6), tactics=("Reconnaissance", "Discovery"), dataset="d", model_params={"rf": {"numTrees": 4, "maxDepth": 3}})


def comparable(rows):
    skip = {"start", "bin_time", "train_time", "test_time"}
    return sorted(str([r[c] for c in RESULTS.names if c not in skip]) for r in rows)


def test_restarted_sweep_has_each_row_once(spark, flow001, monkeypatch):
    out = tempfile.mkdtemp(prefix="flowbin-sweep-", dir="/tmp") + "/r"
    fitted = []
    real = experiment.fit_model

    def breaking(kind, train, cols, **params):
        if len(fitted) >= 3:
            raise RuntimeError("lost")
        fitted.append(len(cols))
        return real(kind, train, cols, **params)

    monkeypatch.setattr(experiment, "fit_model", breaking)
    with pytest.raises(RuntimeError):
        run_experiment(flow001, results_path=out, parallel=1, **SETTINGS)
    assert spark.read.parquet(out).count() == 3
    counted = []
    monkeypatch.setattr(experiment, "fit_model", lambda *a, **k: counted.append(1) or real(*a, **k))
    rows = run_experiment(flow001, results_path=out, **SETTINGS).collect()
    assert len(counted) == 1 and len(rows) == 4  # the rest only
    stored = spark.read.schema(RESULTS).parquet(out).collect()
    fresh = run_experiment(flow001, **SETTINGS).collect()
    assert comparable(rows) == comparable(stored) == comparable(fresh)


def test_other_settings_have_another_key():
    a = experiment.run_key(dataset="d", attack_pct=0.3, tactics=None)
    assert a == experiment.run_key(tactics=None, attack_pct=0.3, dataset="d") != experiment.run_key(dataset="d", attack_pct=0.4, tactics=None)


def test_broken_write_is_written_again(spark):
    out = tempfile.mkdtemp(prefix="flowbin-sink-", dir="/tmp") + "/r"
    sink, name = ResultsSink(spark, out, "k"), ResultsSink.name("a/b: c", "rf", 6)
    row = tuple("t" if f.name == "key" else None for f in RESULTS.fields)
    sink.commit(name, row)
    assert sink.committed() == {name: row} and "/" not in name
    import os
    os.remove(f"{out}/run_key=k/fit={name}/_SUCCESS".removeprefix("file:"))
    assert sink.committed() == {}
    sink.commit(name, row)
    assert sink.committed() == {name: row} and spark.read.parquet(out).count() == 1


def test_one_scoring_pass_equals_single_predictions(spark, flow001):
    ready = prepare_tasks(flow001, binary=True, tactics=("Reconnaissance",))
    one = ready.task("Reconnaissance")
    train, test = one.where("train"), one.where("NOT train")
    fitted = {}
    for kind, n, params in (("rf", 9, {"numTrees": 3}), ("rf", 6, {"numTrees": 3}), ("gbt", 6, {"maxIter": 2})):
        cols = M.feature_columns(one, n)
        fitted[kind, n] = (M.fit_model(kind, train, cols, **params), cols)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    cells = M.score_models(fitted, test)
    jobs = set(tracker.getJobIdsForGroup(None)) - before
    assert len(jobs) <= 2  # the shuffle's map side and its result
    for key, (model, cols) in fitted.items():
        want = {(r.label, r.prediction): r.n for r in confusion(model.transform(M.assemble(test, cols))).collect()}
        assert {(r.label, r.prediction): r.n for r in cells[key]} == want
    assert M.score_models({}, test) == {}
    ready.release()


def test_tasks_are_laid_out_and_pruned(spark, flow001):
    ready = prepare_tasks(flow001, binary=True, min_rows=600)
    assert ready.tasks
    plan = ready.task(ready.tasks[0]).select("label_bin", "history_bin")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in plan and "ReadSchema: struct<label_bin:double,history_bin:int>" in plan
    sizes = {r.task: r.n for r in ready.rows.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert set(sizes) == set(ready.tasks) and min(sizes.values()) >= 600
    ready.release()


def test_gate_can_leave_no_task(spark, flow001):
    assert run_experiment(flow001, binary=False, min_rows=10**9).count() == 0


def test_distinct_state_of_all_groups_in_one_pass(spark, flow001):
    for approx in (False, True):
        got = {(r.protocol, r.cname): r.u for r in distinct_state(flow001, ["history", "service"], ["protocol"], approx).collect()}
        for p in ("tcp", "udp", "icmp"):
            for c in ("history", "service"):
                assert got[p, c] == flow001.where(F.col("protocol") == p).select(c).where(F.col(c).isNotNull()).distinct().count()
