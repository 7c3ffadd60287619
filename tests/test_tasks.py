"""Rebalancing, tasks, gate, split."""

import pytest
from pyspark.sql import functions as F

from flowbin.operators import rebalance as R
from flowbin.operators.split import hash_split, split_flag


def test_benign_quota_rows():
    assert R.benign_quota(100, 0.3) == pytest.approx(233.3333333333)
    assert R.benign_quota(100, 1.0) == 0.0
    with pytest.raises(ValueError):
        R.benign_quota(100, 0.0)


def test_rebalance_attack_share(flow001):
    plan = {r["task"]: r for r in R.rebalance_plan(flow001, 0.3, 10).collect()}
    t = R.rebalance(flow001, 0.3, 10)
    counts = R.task_counts(t).collect()
    for r in counts:
        if r["label_multi"] != "none":
            assert r["n"] == plan[r["task"]]["attack_rows"]
            share = r["n"] / r["task_total"]
            assert abs(share - 0.3) < 0.05
    assert {r["task"] for r in counts} == set(plan)
    assert t.where(F.col("label_multi").isNull()).count() == 0


def test_rebalance_replication_copies(flow001):
    plan = R.rebalance_plan(flow001, 0.05, 3).collect()
    t = R.rebalance(flow001, 0.05, 3)
    for p in plan:
        benign = t.where((F.col("task") == p["task"]) & (F.col("label_multi") == "none"))
        per_uid = benign.groupBy("uid").count()
        lo, hi = per_uid.agg(F.min("count"), F.max("count")).first()
        assert lo >= max(p["copies"], 1) and hi <= p["copies"] + 1


def test_rebalance_is_partitioning_independent(flow001):
    a = R.rebalance(flow001, 0.3, 10).select("task", "uid")
    b = R.rebalance(flow001.repartition(3), 0.3, 10).select("task", "uid")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_benign_rows_is_an_error(spark):
    df = spark.createDataFrame([("u1", "Discovery"), ("u2", "Discovery")], "uid string, label_multi string")
    with pytest.raises(ValueError):
        R.rebalance(df, 0.3, 3)


def test_gate_and_filter(flow001):
    t = R.rebalance(flow001, 0.3, 10)
    sizes = {r["task"]: r["count"] for r in t.groupBy("task").count().collect()}
    kept = {r["task"] for r in R.gate_tasks(t, 500).select("task").distinct().collect()}
    assert kept == {k for k, n in sizes.items() if n >= 500}
    assert R.make_tasks(flow001, binary=False).select("task").distinct().first()["task"] == R.ALL_TASK


def test_hash_split_stable(flow001):
    a = flow001.select("uid", split_flag().alias("s"))
    b = flow001.repartition(5).select("uid", split_flag().alias("s"))
    assert a.exceptAll(b).count() == 0
    train, test = hash_split(flow001)
    n, ntr, nte = flow001.count(), train.count(), test.count()
    assert ntr + nte == n and 0.6 < ntr / n < 0.8


def test_keep_restricts_generated_tasks(flow001):
    t = R.rebalance(flow001, 0.3, 10, keep=["Discovery"])
    assert {r["task"] for r in t.select("task").distinct().collect()} == {"Discovery"}
    full = R.rebalance(flow001, 0.3, 10).where(F.col("task") == "Discovery")
    assert t.exceptAll(full).count() == 0 and full.exceptAll(t).count() == 0
    with pytest.raises(KeyError):
        R.rebalance(flow001, 0.3, 10, keep=["Exfiltration"])


def test_bernoulli_sampler_share(flow001):
    plan = {r["task"]: r for r in R.rebalance_plan(flow001, 0.3, 10).collect()}
    t = R.rebalance(flow001, 0.3, 10, sampler="bernoulli")
    for r in R.task_counts(t).where(F.col("label_multi") == "none").collect():
        p = plan[r["task"]]
        expected = p["quota"]
        assert abs(r["n"] - expected) < 5 * max(1.0, expected ** 0.5)


def test_hash_split_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "uid string")
    train, test = hash_split(df)
    assert train.count() + test.count() == 3
    assert test.where(F.col("uid").isNull()).count() == 1


def test_rows_without_id_are_sampled_too(flow001):
    half = flow001.withColumn("uid", F.when(F.col("orig_pkts") % 2 == 1, F.col("uid")))
    plan = {r["task"]: r for r in R.rebalance_plan(half, 0.3, 10).collect()}
    for r in R.task_counts(R.rebalance(half, 0.3, 10)).where("label_multi = 'none'").collect():
        assert abs(r["n"] - plan[r["task"]]["quota"]) < 5 * max(1.0, plan[r["task"]]["quota"] ** 0.5)
