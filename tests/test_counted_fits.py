"""Fits and scores on counted rows: weights, partitions by rows, the same trees and cells."""

import pytest
from pyspark.sql import functions as F

from flowbin.operators import models as M
from flowbin.operators.metrics import confusion


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(0, 6_000, 1, 5)
    return r.select((F.col("id") * 7 % 5 < 2).cast("double").alias("label_bin"), (F.col("id") * 7 % 5 + F.col("id") % 3).cast("int").alias("a"),
                    F.when(F.col("id") % 7 == 0, 0).otherwise(3).cast("int").alias("b"), (F.col("id") % 4).cast("int").alias("c"))


COLS = ["a", "b", "c"]


def test_partitions_of_a_fit_follow_the_rows_not_the_bytes(spark, rows, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 400)
    counted = M.equal_rows(rows, ["label_bin", *COLS])
    groups = counted.count()
    fit, kept = M.rows_to_fit(counted, COLS, 6_000, groups, 1)
    assert fit.rdd.getNumPartitions() == 15 and fit.count() == 6_000
    assert fit.groupBy("label_bin", *COLS).count().exceptAll(counted).isEmpty()
    kept.unpersist()


@pytest.mark.parametrize("most", [None, 1, 7, 10_000])
def test_weights_hold_every_row_once(rows, most):
    counted = M.equal_rows(rows, ["label_bin", *COLS])
    groups = counted.count()
    fit, kept = M.rows_to_fit(counted, ["a"], 6_000, groups, most)
    got = {(r.label_bin, r.a): (r.w, r.n, r.top) for r in fit.groupBy("label_bin", "a").agg(F.sum(M.WEIGHT).alias("w"), F.count("*").alias("n"), F.max(M.WEIGHT).alias("top")).collect()}
    want = {(r.label_bin, r.a): r["count"] for r in rows.groupBy("label_bin", "a").count().collect()}
    assert got.keys() == want.keys()
    for key, n in want.items():
        assert got[key][0] == pytest.approx(n)
        assert got[key][1] == (1 if most is None else -(-n // most)) and got[key][2] <= (most or n) + 1e-9
    kept.unpersist()


def test_blocks_of_one_group_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 2_000)
    same = spark.range(20_000).select(F.lit(1.0).alias("label_bin"), F.lit(2).alias("a"), F.lit(20_000).cast("long").alias("k")).limit(1)
    fit, kept = M.rows_to_fit(same, ["a"], 20_000, 1, 1)
    sizes = [r["count"] for r in fit.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 3
    kept.unpersist()


def test_boosted_trees_of_counted_rows_are_those_of_the_rows(rows):
    counted = M.equal_rows(rows, ["label_bin", *COLS])
    fit, kept = M.rows_to_fit(counted, COLS, 6_000, counted.count(), M.rows_a_draw("gbt", 6_000, {}))
    assert fit.count() < 200
    one = M.fit_model("gbt", rows, COLS, maxIter=3)
    two = M.fit_model("gbt", fit, COLS, weight_col=M.WEIGHT, maxIter=3)
    test = M.assemble(rows.distinct(), COLS)
    near = lambda m: {(r.a, r.b, r.c): r.p for r in m.transform(test).select("a", "b", "c", F.col("rawPrediction").cast("string").alias("p")).collect()}
    value = lambda t: [float(x) for x in t.strip("[]").split(",")]
    x, y = near(one), near(two)
    assert x.keys() == y.keys() and all(value(x[k]) == pytest.approx(value(y[k]), abs=1e-9) for k in x)
    kept.unpersist()


def test_scores_of_counted_rows(rows):
    model = M.fit_model("rf", rows, ["a"], numTrees=2, maxDepth=2)
    cells = M.score_models({"m": (model, ["a"])}, M.equal_rows(rows, ["label_bin", *COLS]), count_col="k")["m"]
    want = {(r.label, r.prediction): r.n for r in confusion(model.transform(M.assemble(rows, ["a"]))).collect()}
    assert {(r.label, r.prediction): r.n for r in cells} == want


def test_draws_stay_single_up_to_a_bound(monkeypatch):
    assert M.rows_a_draw("rf", M.DRAWN_ROWS, {}) == 1 and M.rows_a_draw("rf", M.DRAWN_ROWS * 3, {}) == 3
    assert M.rows_a_draw("gbt", 10**12, {}) is None and M.rows_a_draw("rf", 10**12, {"numTrees": 1}) is None
    assert M.rows_a_draw("gbt", M.DRAWN_ROWS * 2, {"subsamplingRate": 0.5}) == 2
    assert M.rows_a_draw("gbt", 10**12, {"minInstancesPerNode": 5}) == 1
