"""Physical-plan properties that matter at scale."""

from pyspark.sql import functions as F

from flowbin.operators import rebalance as R
from flowbin.operators.binning import BinningModel
from flowbin.operators.frequency import value_counts
from flowbin.operators.metrics import class_metrics
from flowbin.plans.experiment import feature_distinct_counts
from flowbin.sources import fixtures
from flowbin.sources.schema import BOOL_COLS, NOMINAL_COLS
from paths import SF001


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return [ln.strip() for ln in plan.splitlines() if "Exchange" in ln]


def test_rebalance_is_one_map_only_pass(flow001):
    p = plan_of(R.rebalance(flow001, 0.05, 3))
    assert "Join" not in p and "Python" not in p
    assert not exchanges(p)
    assert p.count("Scan parquet") == 1 or p.count("FileScan") == 1


def test_grouped_transform_reads_its_input_once(flow001):
    df = flow001.withColumn("task", F.when(F.col("orig_pkts") < 25, "a").otherwise("b"))
    m = BinningModel.fit(df, by=["task"])
    p = plan_of(m.transform(df))
    # one join with the groups' parameters and one lookup for each frequency column, all broadcast
    assert p.count("BroadcastHashJoin") == 1 + len(BOOL_COLS + NOMINAL_COLS) and "SortMergeJoin" not in p and "Python" not in p
    assert all("BroadcastExchange" in e for e in exchanges(p))
    assert p.count("lineitem.parquet") == 1
    m.release()


def test_wide_lookups_read_their_input_once(flow001):
    m = BinningModel.fit(flow001)
    p = plan_of(m.transform(flow001, broadcast_bytes=60))
    assert p.count("lineitem.parquet") == 1 and "RoundRobinPartitioning" not in p
    m.release()


def test_value_counts_aggregates_before_the_shuffle(flow001):
    p = plan_of(value_counts(flow001, BOOL_COLS + NOMINAL_COLS))
    lines = [ln.strip() for ln in p.splitlines()]
    shuffle = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    assert any("partial_count" in ln for ln in lines[shuffle + 1:])
    assert "SinglePartition" not in p


def test_distinct_counts_do_not_expand(flow001):
    p = plan_of(feature_distinct_counts(flow001, BOOL_COLS + NOMINAL_COLS))
    assert "Expand" not in p


def test_metrics_are_one_small_aggregate(spark):
    p = plan_of(class_metrics(fixtures.scored(spark, SF001)))
    assert "Python" not in p and "Join" not in p


def test_queries_leave_nothing_persisted(spark):
    from flowbin.plans.queries import QUERIES

    for name in ("full_bin", "trim_stats", "label_multiclass", "nominal_coverage_join", "grouped_bin_null_group", "csv_scan"):
        QUERIES[name](spark, SF001).count()
        assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty(), name
