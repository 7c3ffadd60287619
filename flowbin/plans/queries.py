"""Named queries over the driver's tables (one per operator of the inventory).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole ``lineitem``-derived flow table.  Column names match the oracle SQL in
:mod:`flowbin.plans.oracle`; computed doubles that are sums or ratios are
rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbin.functions.classes import ip_class, port_class
from flowbin.operators import metrics as M
from flowbin.operators import rebalance as R
from flowbin.operators.binning import BinningConfig, BinningModel
from flowbin.operators.models import assemble, feature_columns
from flowbin.operators.numeric import edges_frame, trim_stats
from flowbin.operators.split import hash_split, split_flag
from flowbin.plans.experiment import feature_distinct_counts, run_experiment
from flowbin.plans.labelling import add_binary_label, add_multiclass_label
from flowbin.session import materialize, remove_path, shared_scratch
from flowbin.sources import fixtures
from flowbin.sources.results import RESULTS, read_flows
from flowbin.sources.schema import (
    BOOL_COLS, FLOW_RAW, IP_COLS, NOMINAL_COLS, NUMERIC_COLS, PORT_COLS, rename_flow,
)

Query = Callable[[SparkSession, str], DataFrame]


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_flow(fixtures.conn(spark, sf_dir))


def _only(**kw) -> BinningConfig:
    base = dict(ip=[], port=[], boolean=[], nominal=[], numeric=[])
    base.update(kw)
    return BinningConfig(**base)


def q_rename_flow(spark, d):
    return flow(spark, d)


def q_csv_scan(spark, d):
    """Written with another column order and one column more, read back by name."""
    path = shared_scratch(spark, "csv_scan")
    conn = fixtures.conn(spark, d)
    order = sorted(conn.columns, key=lambda c: c[::-1])
    conn.select(*order[:9], F.lit("x").alias("note"), *order[9:]).write.option("header", True).csv(path)
    df = materialize(read_flows(spark, path, "csv").select(*FLOW_RAW.names))
    remove_path(spark, path)
    return df


def q_label_counts(spark, d):
    return R.label_counts(flow(spark, d))


def q_top_labels(spark, d):
    return R.top_labels(flow(spark, d), 3)


def q_benign_quota(spark, d):
    return R.rebalance_plan(flow(spark, d), 0.3, 10)


def q_rebalance_undersample(spark, d):
    return R.rebalance(flow(spark, d), 0.3, 10)


def q_rebalance_replicate(spark, d):
    return R.rebalance(flow(spark, d), 0.05, 10)


def q_label_counts_by_task(spark, d):
    return R.task_counts(R.rebalance(flow(spark, d), 0.3, 10))


def q_task_size_gate(spark, d):
    return R.gate_tasks(R.rebalance(flow(spark, d), 0.3, 10), 500).select("task", "uid", "label_multi")


def q_task_filter(spark, d):
    return R.make_tasks(flow(spark, d), True, 0.3, 10, R.DEFAULT_TACTICS).select("task", "uid", "label_multi")


def q_label_binary(spark, d):
    return add_binary_label(flow(spark, d)).select("uid", "label_multi", "label_bin")


def q_label_multiclass(spark, d):
    return add_multiclass_label(flow(spark, d)).select("uid", "label_multi", "label_multi_bin", "label_bin")


def q_ip_class_bin(spark, d):
    return flow(spark, d).select("uid", "src_ip", "dest_ip",
                                 *[ip_class(c).alias(c + "_bin") for c in IP_COLS])


def q_port_class_bin(spark, d):
    return flow(spark, d).select("uid", "src_port", "dest_port",
                                 *[port_class(c).alias(c + "_bin") for c in PORT_COLS])


def _bins(spark, d, cfg: BinningConfig, keep=("uid",)):
    f = flow(spark, d)
    m = BinningModel.fit(f, cfg)
    return m.transform(f).select(*keep, *m.feature_names())


def q_boolean_index(spark, d):
    return _bins(spark, d, _only(boolean=BOOL_COLS))


def q_nominal_index(spark, d):
    return _bins(spark, d, _only(nominal=NOMINAL_COLS))


COVERAGE = dict(nominal=NOMINAL_COLS, nominal_mode="coverage", nominal_coverage=0.98)


def q_nominal_coverage_bin(spark, d):
    return _bins(spark, d, _only(**COVERAGE), keep=("uid", "history"))


def q_nominal_coverage_join(spark, d):
    """The coverage bin by the shuffle join that wide columns take (J1): all but one
    entry of each column are beyond the broadcast bound."""
    f = flow(spark, d)
    m = BinningModel.fit(f, _only(**COVERAGE))
    return m.transform(f, broadcast_bytes=60).select("uid", "history", *m.feature_names())


def q_grouped_bin_null_group(spark, d):
    """Bins fitted per priority where one priority has no value of either column."""
    low = F.col("o_orderpriority") == "5-LOW"
    o = fixtures.table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(~low, F.col("o_totalprice")).alias("price"), F.when(~low, F.col("o_orderstatus")).alias("status"))
    m = BinningModel.fit(o, _only(numeric=["price"], nominal=["status"]), by=["o_orderpriority"])
    return m.transform(o).select("o_orderkey", "o_orderpriority", "price_bin", "status_bin")


def q_rebalance_null_uid(spark, d):
    """Undersampling where every other line number has no id."""
    f = flow(spark, d).withColumn("uid", F.when(F.col("orig_pkts") % 2 == 1, F.col("uid")))
    return R.rebalance(f, 0.3, 10).select("task", "uid", "community_id", "label_multi", "orig_bytes")


def q_numeric_bin_by_group(spark, d):
    """Std-dev bins fitted per group (as per task): order price per priority."""
    o = fixtures.table(spark, d, "orders")
    m = BinningModel.fit(o, _only(numeric=["o_totalprice"]), by=["o_orderpriority"])
    return m.transform(o).select("o_orderkey", "o_orderpriority", "o_totalprice_bin")


def q_events_bin(spark, d):
    """The binning model on another table: event value and event type."""
    e = fixtures.table(spark, d, "events")
    m = BinningModel.fit(e, _only(nominal=["event_type"], numeric=["value"]))
    return m.transform(e).select("event_id", "event_type_bin", "value_bin")


def q_trim_stats(spark, d):
    s = trim_stats(flow(spark, d), NUMERIC_COLS, 0.02)
    return s.select("cname", "n_rows", "n_kept",
                    *[F.round(c, 6).alias(c) for c in ("mean", "sd", "minimum")])


def q_numeric_edges(spark, d):
    e = edges_frame(trim_stats(flow(spark, d), NUMERIC_COLS, 0.02))
    return e.select("cname", *[F.round(c, 6).alias(c) for c in ("center", "e1", "e2", "e3", "e4", "e5")])


def q_numeric_bin(spark, d):
    return _bins(spark, d, _only(numeric=NUMERIC_COLS))


def q_full_bin(spark, d):
    return _bins(spark, d, BinningConfig())


def q_full_bin_replace(spark, d):
    f = flow(spark, d)
    cfg = BinningConfig()
    m = BinningModel.fit(f, cfg)
    return m.transform(f, replace=True).select(
        "uid", "ts", "datetime", "community_id", "label_multi", *cfg.binned_columns())


def q_feature_distinct_counts(spark, d):
    """Of the training rows, as each run reports them."""
    fb = q_full_bin(spark, d)
    return feature_distinct_counts(hash_split(fb)[0], [c for c in fb.columns if c != "uid"])


def q_hash_split(spark, d):
    return flow(spark, d).select("uid", split_flag(0.7).alias("split"))


def q_confusion_matrix(spark, d):
    return M.confusion(fixtures.scored(spark, d))


def q_class_metrics(spark, d):
    return M.class_metrics(fixtures.scored(spark, d), digits=6)


def q_auc_hard(spark, d):
    return M.auc_hard(fixtures.scored(spark, d), digits=6)


def q_feature_vectors(spark, d):
    f = add_binary_label(flow(spark, d))
    m = BinningModel.fit(f)
    binned = m.transform(f)
    cols = feature_columns(binned, 18)
    return assemble(binned, cols).select("uid", "label_bin", vector_to_array("features").alias("features"))


def _checked(results, binary):
    """A results table without clocks: what each run was, its test rows by actual
    class, and whether every metric follows from its confusion matrix."""
    m = F.col("cfsn_mtrx")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    rows = F.transform(m, total)
    one = 1  # position of label 1.0: after 0.0 (attack, or no label)
    tp = F.get(F.get(m, F.lit(one)), F.lit(one))
    fn = F.get(rows, F.lit(one)) - tp
    fp = total(F.transform(m, lambda r: F.get(r, F.lit(one)))) - tp
    tn = total(rows) - tp - fn - fp
    right = total(F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(F.get(m, i), i)))
    same = lambda c, x: (F.coalesce(F.abs(F.col(c) - x), F.lit(0.0)) < 1e-9) & (F.col(c).isNull() == x.isNull())
    ratio = lambda a, b: F.when(b > 0, a / b)
    auc = (ratio(tp, tp + fn) + 1.0 - ratio(fp, fp + tn)) / 2.0
    return results.select(
        "key", "model", "num_features", F.array_join("feature_cols", " ").alias("feature_list"),
        F.array_join(F.transform(rows, lambda x: x.cast("long").cast("string")), " ").alias("actual"), total(rows).cast("long").alias("test_rows"),
        same("accuracy", right / total(rows)).alias("accuracy_ok"), same("recall", ratio(tp, tp + fn)).alias("recall_ok"),
        same("precision", F.coalesce(ratio(tp, tp + fp), F.lit(0.0))).alias("precision_ok"),
        same("f_measure", F.coalesce(ratio(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))).alias("f_measure_ok"),
        same("false_positive", ratio(fp, fp + tn)).alias("false_positive_ok"),
        (same("area_under_curve", auc) if binary else F.col("area_under_curve").isNull()).alias("auc_ok"))


def q_rf_binary(spark, d):
    """Every top tactic against benign rows, random forest, all feature prefixes."""
    return _checked(run_experiment(flow(spark, d), binary=True, models=("rf",), dataset=d), True)


def q_gbt_binary(spark, d):
    """The same with gradient-boosted trees."""
    return _checked(run_experiment(flow(spark, d), binary=True, models=("gbt",), dataset=d), True)


def q_rf_multiclass(spark, d):
    return _checked(run_experiment(flow(spark, d), binary=False, models=("rf",), prefixes=(18,), dataset=d), False)


def q_ablation(spark, d):
    """The shipped run: multi-class, random forest, feature prefixes 18/12/9/6."""
    return _checked(run_experiment(flow(spark, d), binary=False, models=("rf",), dataset=d), False)


def q_results_append(spark, d):
    """The results folder of a run, as appended fit by fit and read back."""
    path = shared_scratch(spark, "results")
    run_experiment(flow(spark, d), binary=True, models=("rf",), prefixes=(6,), dataset=d, results_path=path)
    back = materialize(spark.read.schema(RESULTS).parquet(path))
    remove_path(spark, path)
    return _checked(back, True)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
