"""Metrics against MLlib, models, the experiment sweep and streaming."""

import tempfile

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from flowbin.operators.metrics import class_metrics, confusion, confusion_matrix
from flowbin.sources import fixtures
from paths import SF001


def test_auc_hard_unit(spark):
    rows = [(1.0, 1.0)] * 5 + [(1.0, 0.0)] * 3 + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 7
    df = spark.createDataFrame(rows, "label_bin double, prediction double")
    assert class_metrics(df).first()["auc_hard"] == pytest.approx(0.7013888888888888)


def test_metrics_agree_with_mllib(spark):
    pred = fixtures.scored(spark, SF001)
    ours = class_metrics(pred).first()
    ev = MulticlassClassificationEvaluator(labelCol="label_bin", predictionCol="prediction")
    ref = {
        "accuracy": ev.evaluate(pred, {ev.metricName: "accuracy"}),
        "precision": ev.evaluate(pred, {ev.metricName: "precisionByLabel", ev.metricLabel: 1.0}),
        "recall": ev.evaluate(pred, {ev.metricName: "recallByLabel", ev.metricLabel: 1.0}),
        "f_measure": ev.evaluate(pred, {ev.metricName: "fMeasureByLabel", ev.metricLabel: 1.0}),
        "true_positive": ev.evaluate(pred, {ev.metricName: "truePositiveRateByLabel", ev.metricLabel: 1.0}),
        "false_positive": ev.evaluate(pred, {ev.metricName: "falsePositiveRateByLabel", ev.metricLabel: 1.0}),
    }
    for k, v in ref.items():
        assert ours[k] == pytest.approx(v, abs=1e-12), k


def test_confusion_matrix_dense(spark):
    pred = fixtures.scored(spark, SF001)
    mat = confusion_matrix(confusion(pred).collect())
    assert len(mat) == 2 and sum(map(sum, mat)) == pred.count()


def test_confusion_matrix_has_the_actual_classes_only(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0), (2.0, 2.0)], "label_bin double, prediction double")
    assert confusion_matrix(confusion(df).collect()) == [[1.0, 0.0], [0.0, 1.0]]


def test_a_failing_second_model_leaves_the_first_row(spark, flow001):
    from flowbin.plans.experiment import run_experiment

    out = tempfile.mkdtemp(prefix="flowbin-res-", dir="/tmp") + "/r"
    with pytest.raises(Exception):
        run_experiment(flow001, binary=True, models=("rf", "gbt"), prefixes=(6,), tactics=("Discovery",),
                       results_path=out, model_params={"gbt": {"maxIter": -1}})
    assert [r["model"] for r in spark.read.parquet(out).collect()] == ["rf"]


def test_experiment_binary_rows(spark, flow001):
    from flowbin.plans.experiment import run_experiment

    out_dir = tempfile.mkdtemp(prefix="flowbin-res-", dir="/tmp")
    res = run_experiment(flow001, binary=True, models=("rf", "gbt"), prefixes=(6,),
                         tactics=("Reconnaissance", "Discovery"), results_path=out_dir + "/r")
    rows = res.collect()
    assert {(r["key"], r["model"]) for r in rows} == {
        ("Reconnaissance", "rf"), ("Reconnaissance", "gbt"), ("Discovery", "rf"), ("Discovery", "gbt")}
    for r in rows:
        assert r["num_features"] == 6 and len(r["feature_cols"]) == 6
        assert 0.0 <= r["accuracy"] <= 1.0 and r["area_under_curve"] is not None
    assert spark.read.parquet(out_dir + "/r").count() == 4


def test_gbt_rejects_multiclass(spark, flow001):
    from flowbin.plans.experiment import run_experiment

    with pytest.raises(ValueError):
        run_experiment(flow001, binary=False, models=("gbt",), prefixes=(6,))


def test_stream_bins_equal_batch_bins(spark, flow001):
    from flowbin.operators.binning import BinningModel
    from flowbin.sources.schema import FLOW
    from flowbin.streaming import bin_stream

    src = tempfile.mkdtemp(prefix="flowbin-stream-", dir="/tmp")
    flow001.write.mode("overwrite").parquet(src + "/in")
    m = BinningModel.fit(flow001)
    stream = spark.readStream.schema(FLOW).parquet(src + "/in")
    q = (bin_stream(m, stream).select("uid", *m.feature_names()).writeStream
         .format("memory").queryName("binned_stream").outputMode("append")
         .option("checkpointLocation", src + "/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("binned_stream")
    want = m.transform(flow001).select("uid", *m.feature_names())
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_fit_bins_on_train(spark, flow001):
    from flowbin.plans.experiment import prepare

    binned_all, m_all, _ = prepare(flow001, binary=True, tactics=("Reconnaissance",))
    binned_tr, m_tr, _ = prepare(flow001, binary=True, tactics=("Reconnaissance",), fit_bins_on="train")
    assert binned_all.count() == binned_tr.count()
    key = (("Reconnaissance",), "duration")
    assert m_tr.numeric[key].n_rows < m_all.numeric[key].n_rows


def test_distinct_counts_exact_and_approx(spark, flow001):
    from flowbin.plans.experiment import feature_distinct_counts

    cols = ["protocol", "history", "orig_pkts"]
    exact = feature_distinct_counts(flow001, cols).first()
    approx = feature_distinct_counts(flow001, cols, approx=True).first()
    for c in cols:
        assert exact[c] == flow001.select(c).where(F.col(c).isNotNull()).distinct().count()
        assert abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c])


def test_folded_multiclass_label_equals_labeller(spark, flow001):
    from flowbin.plans.experiment import prepare
    from flowbin.plans.labelling import add_multiclass_label
    from flowbin.operators.rebalance import make_tasks

    binned, _, _ = prepare(flow001, binary=False)
    ref = add_multiclass_label(make_tasks(flow001, binary=False), by=["task"])
    j = binned.select("uid", "label_bin").join(ref.select("uid", F.col("label_bin").alias("r")), "uid")
    assert j.count() == flow001.count()
    assert j.where(F.col("label_bin") != F.col("r")).count() == 0


def test_score_stream_equals_batch_predictions(spark, flow001):
    from flowbin.operators.binning import BinningModel
    from flowbin.operators.models import assemble, make_model
    from flowbin.plans.labelling import add_binary_label
    from flowbin.sources.schema import FLOW
    from flowbin.streaming import score_stream

    labelled = add_binary_label(flow001)
    m = BinningModel.fit(labelled)
    cols = m.feature_names()[:6]
    rf = make_model("rf", numTrees=5, maxDepth=3).fit(assemble(m.transform(labelled), cols))
    src = tempfile.mkdtemp(prefix="flowbin-score-", dir="/tmp")
    flow001.write.parquet(src + "/in")
    stream = spark.readStream.schema(FLOW).parquet(src + "/in")
    q = (score_stream(m, rf, cols, stream).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").option("checkpointLocation", src + "/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_stream")
    want = rf.transform(assemble(m.transform(flow001), cols)).select("uid", "prediction")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
