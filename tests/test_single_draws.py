"""Forests of the sweep draw single rows, whatever the size of the table."""

import tempfile

import pytest
from pyspark.sql import functions as F

from flowbin.operators import models as M
from flowbin.operators.rebalance import make_tasks
from flowbin.operators.split import split_flag
from flowbin.plans import experiment
from flowbin.plans.queries import QUERIES, flow
from paths import SF001


@pytest.fixture(scope="module")
def thrice(spark):
    """A folder whose lineitem has every row three times."""
    at = tempfile.mkdtemp(prefix="flowbin-thrice-", dir="/tmp")
    one = spark.read.parquet(f"{SF001}/lineitem.parquet")
    one.unionAll(one).unionAll(one).write.parquet(f"{at}/lineitem.parquet")
    return at


def rows_of_fits(spark, at, query, monkeypatch):
    """(rows, rows that they stand for, largest weight) of every fit of the query."""
    seen, real = [], experiment.fit_model

    def fit(kind, train, cols, weight_col=None, **params):
        seen.append(tuple(train.agg(F.count("*"), F.sum(weight_col), F.max(weight_col)).first()))
        return real(kind, train, cols, weight_col=weight_col, numTrees=2, maxDepth=2)

    monkeypatch.setattr(M, "DRAWN_ROWS", 500)  # far fewer than the table has
    monkeypatch.setattr(experiment, "fit_model", fit)
    assert QUERIES[query](spark, at).where("NOT accuracy_ok").isEmpty()
    return sorted(seen)


def training_rows(spark, at, binary):
    tasks = make_tasks(flow(spark, at), binary, 0.3, 10, None)
    n = tasks.withColumn("side", split_flag(0.7)).groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "train").alias("train"))
    return [r["train"] for r in n.where("n >= 500").collect()]


def test_ablation(spark, thrice, monkeypatch):
    (n,) = training_rows(spark, thrice, False)
    assert n > 10_000 and rows_of_fits(spark, thrice, "ablation", monkeypatch) == [(n, n, 1.0)] * 4


def test_results_append(spark, thrice, monkeypatch):
    sizes = sorted(training_rows(spark, thrice, True))
    assert len(sizes) > 1 and rows_of_fits(spark, thrice, "results_append", monkeypatch) == [(n, n, 1.0) for n in sizes]


def test_rf_multiclass(spark, thrice, monkeypatch):
    (n,) = training_rows(spark, thrice, False)
    assert rows_of_fits(spark, thrice, "rf_multiclass", monkeypatch) == [(n, n, 1.0)]


def test_only_fits_that_use_each_row_as_it_is_take_weights():
    assert M.single_rows("rf", {}) and M.single_rows("rf", {"bootstrap": False, "subsamplingRate": 0.5})
    assert M.single_rows("gbt", {"subsamplingRate": 0.5}) and M.single_rows("gbt", {"minInstancesPerNode": 5})
    assert not M.single_rows("gbt", {}) and not M.single_rows("rf", {"bootstrap": False})


def test_a_single_tree_draws_too(spark):
    """Its root holds a bootstrap, so equal rows may not be one row."""
    rows = spark.range(1_000).select((F.col("id") % 2).cast("double").alias("label_bin"), (F.col("id") % 5).cast("int").alias("a"))
    (tree,) = M.fit_model("rf", rows, ["a"], numTrees=1, seed=5).trees
    assert list(tree._call_java("rootNode").impurityStats().stats()) != [500.0, 500.0]
    assert M.single_rows("rf", {"numTrees": 1})
