"""Row groups, passes over the source, merged states, saved models and many groups."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowbin.operators.binning import BinningConfig, BinningModel
from flowbin.operators.frequency import class_of_count, count_of_class, entry_sizes
from flowbin.operators.state import bucket, column_state, merge_states
from flowbin.session import store
from flowbin.sources import splits
from flowbin.sources.schema import NOMINAL_COLS, NUMERIC_COLS
from test_plans import exchanges, plan_of


def folder(name):
    return tempfile.mkdtemp(prefix="flowbin-scan-", dir="/tmp") + "/" + name


def test_one_row_group_is_dealt_out_after_pruning(spark):
    path = folder("one")
    spark.range(200_000).select("id", (F.col("id") * 2).alias("a"), F.lit("x").alias("unused")).coalesce(1).write.parquet(path)
    df = splits.read_parquet(spark, path, cores=8).select((F.col("a") + 1).alias("b"))
    plan = plan_of(df)
    assert len(exchanges(plan)) == 1 and "RoundRobinPartitioning(8)" in plan
    assert "unused" not in plan and "ReadSchema: struct<a:bigint>" in plan
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_many_row_groups_or_files_and_small_tables_get_no_exchange(spark):
    files, groups, small = folder("files"), folder("groups"), folder("small")
    spark.range(200_000).repartition(8).write.parquet(files)
    # checked every 100 rows, a row group is closed beyond 64 kB
    spark.range(400_000).select("id", F.md5(F.col("id").cast("string")).alias("h")).coalesce(1).write.option("parquet.block.size", 65536).option(
        "parquet.page.size", 8192).option("parquet.page.size.row.check.min", 100).option("parquet.block.size.row.check.min", 100).parquet(groups)
    spark.range(2_000).coalesce(1).write.parquet(small)
    footers = [splits.row_groups(spark, f) for f in spark.read.parquet(groups).inputFiles()]
    assert len(footers) == 1 and len(footers[0][1]) > 8 and footers[0][2] == 400_000
    for path in (files, groups, small):
        assert not exchanges(plan_of(splits.read_parquet(spark, path, cores=4))), path


def test_full_splits_counts_middles():
    one = (1000, [(4, 900)], 10)
    assert splits.full_splits([one], 100) == 1
    assert splits.full_splits([(1000, [(0, 100), (100, 100), (200, 700)], 10)], 100) == 3
    assert splits.full_splits([one, one], 5000) == 2


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_fit_and_transform_scan_the_source_three_times(spark, flow001, by):
    """The rows that leave the source are counted where they leave it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stored, _ = store(flow001.withColumn("grp", F.when(F.col("orig_pkts") < 25, "low")))
    df = stored.mapInArrow(count, stored.schema)
    n = stored.count()
    model = BinningModel.fit(df, by=by)
    assert seen.value == 2 * n
    got = model.transform(df).select("uid", *model.feature_names())
    out, _ = store(got)
    assert seen.value == 3 * n
    want = BinningModel.fit(stored, by=by).transform(stored).select("uid", *model.feature_names())
    assert out.exceptAll(want).count() == 0 and out.count() == n
    model.release()


def test_buckets_rise_with_the_value(spark):
    values = [float("-inf"), -1e300, -3.5, -2.0, -1.9999999999999998, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-310, 1e-300, 0.1, 0.9999999999999999, 1.0,
              1.0000000000000002, 1.5, 1.9999999999999998, 2.0, 3.0, 1e15, 1e300, 1.7976931348623157e308, float("inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", bucket(F.col("x")).alias("b")).orderBy("i").collect()
    found = [r["b"] for r in rows]
    assert found == sorted(found) and found[8] == 0 and found[13] < found[14] <= found[15] and found[-1] > found[-2]
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "x double").select(bucket(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in odd] == [None, None, 0]


def test_states_of_parts_merge(spark, flow001):
    whole = column_state(flow001, ["history"], ["duration"], ["protocol"])
    parts = [column_state(flow001.where(F.col("orig_pkts") % 3 == i), ["history"], ["duration"], ["protocol"]) for i in range(3)]
    merged = merge_states(parts, ["protocol"])
    assert merged.count() == whole.count() and merged.exceptAll(whole.select(*merged.columns)).count() == 0


def test_saved_model_gives_the_same_bins(spark, flow001):
    path = folder("model")
    df = flow001.withColumn("grp", F.when(F.col("orig_pkts") < 25, "low"))
    for by, at in ((["grp"], path),):
        config = BinningConfig(nominal_mode="coverage", extra_coverage={"label_multi": 1.0})
        model = BinningModel.fit(df, config, by=by)
        model.save(at)
        names = ["uid", *model.feature_names(), "label_multi_bin"]
        want, _ = store(model.transform(df).select(*names))
        model.release()
        back = BinningModel.load(spark, at)
        got = back.transform(df, broadcast_bytes=300).select(*names)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
        with pytest.raises(Exception):
            BinningModel.load(spark, at).save(at)  # the folder is there already


def test_wide_lookup_takes_its_head_without_a_sort(spark, flow001):
    m = BinningModel.fit(flow001, BinningConfig(ip=[], port=[], boolean=[], numeric=[], nominal=NOMINAL_COLS))
    plan = plan_of(m.transform(flow001, broadcast_bytes=400))
    assert "TakeOrdered" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    sizes = m.frequency.sizes["history"]
    assert sum(n for n, _ in sizes.values()) == flow001.select("history").distinct().count()
    least = m.frequency.head("history", 400)
    held = m.frequency.entries.where((F.col("slot") == "history") & (F.col("k") >= least))
    assert sum(b for x in entry_sizes(held, []).values() for _, b in x.values()) <= 400


def test_size_classes_split_at_their_least_count(spark):
    classes = [c for c in range(60) if count_of_class(c) > count_of_class(c - 1)]
    rows = spark.createDataFrame([(c, count_of_class(c)) for c in classes], "c int, k long")
    for r in rows.select("c", class_of_count(F.col("k")).alias("at"), class_of_count(F.greatest(F.lit(1), F.col("k") - 1)).alias("below"), "k").collect():
        assert r.at >= r.c and (r.k == 1 or r.below < r.c)


def test_many_groups_stay_in_tables(spark):
    """Twenty thousand groups: beyond the broadcast bound, nothing of theirs on the driver."""
    n = 20_000
    df = spark.range(4 * n).select((F.col("id") % n).alias("g"), (F.col("id") % 7).cast("string").alias("x"), (F.col("id") / n).cast("double").alias("y"))
    m = BinningModel.fit(df, BinningConfig(ip=[], port=[], boolean=[], nominal=["x"], numeric=["y"]), by=["g"])
    assert m.n_groups == n and m.params.count() == n
    out = m.transform(df)
    plan = plan_of(out)
    assert "LocalTableScan" not in plan
    assert out.count() == 4 * n and out.where("x_bin IS NULL OR y_bin IS NULL").count() == 0
    one = BinningModel.fit(df.where("g = 17"), m.config).transform(df.where("g = 17"))
    assert sorted((r.x_bin, r.y_bin) for r in one.collect()) == sorted((r.x_bin, r.y_bin) for r in out.where("g = 17").collect())


def test_group_sizes_come_from_the_state(spark, flow001):
    df = flow001.withColumn("grp", F.when(F.col("orig_pkts") < 25, "low"))
    m = BinningModel.fit(df, BinningConfig(ip=[], port=[], boolean=["local_resp"], nominal=["service"], numeric=NUMERIC_COLS[:2]), by=["grp"])
    assert {tuple(r) for r in m.group_rows().collect()} == {tuple(r) for r in df.groupBy("grp").count().collect()}


def test_empty_table_fits(spark, flow001):
    m = BinningModel.fit(flow001.limit(0))
    assert m.transform(flow001.limit(0)).count() == 0
    assert os.path.isdir(m.paths[0].removeprefix("file:"))
    m.release()
    assert not os.path.isdir(m.paths[0].removeprefix("file:"))
