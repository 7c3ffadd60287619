"""Binning operators: unit rows, agreement with MLlib, forced distributed paths."""

import math

import pytest
from pyspark.ml.feature import Bucketizer, StringIndexer
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowbin.operators.binning import BinningConfig, BinningModel
from flowbin.operators.numeric import fit_numeric, trim_stats
from flowbin.operators.ranking import rank_and_cumsum
from flowbin.sources.schema import BOOL_COLS, NOMINAL_COLS, NUMERIC_COLS


def only(**kw):
    base = dict(ip=[], port=[], boolean=[], nominal=[], numeric=[])
    base.update(kw)
    return BinningConfig(**base)


def bins_of(spark, values, col_type="double", **cfg):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {col_type}")
    m = BinningModel.fit(df, only(**cfg))
    return [r["x_bin"] for r in m.transform(df).orderBy("i").collect()], m


def test_stddev_constant_column(spark):
    got, m = bins_of(spark, [7.0] * 20, numeric=["x"])
    assert set(got) == {2}
    spec = m.numeric[((), "x")]
    assert spec.edges == [7.0] and spec.sd == 0.0
    df = spark.createDataFrame([(6.9,), (None,), (float("nan"),)], "x double")
    assert [r["x_bin"] for r in m.transform(df).collect()] == [1, 0, 3]


def test_stddev_nan_with_six_buckets(spark):
    _, m = bins_of(spark, [float(i) for i in range(1, 101)], numeric=["x"])
    spec = m.numeric[((), "x")]
    assert len(spec.edges) == 5
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert m.transform(df).first()["x_bin"] == 7


def test_trim_keeps_rows_2_to_98(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    s = trim_stats(df, ["x"], 0.02).first()
    assert s["n_rows"] == 100 and s["n_kept"] == 97 and s["minimum"] == 2.0
    kept = list(range(2, 99))
    assert s["mean"] == pytest.approx(sum(kept) / 97)
    m = sum(kept) / 97
    assert s["sd"] == pytest.approx(math.sqrt(sum((k - m) ** 2 for k in kept) / 96))


def test_trim_small_column_keeps_all(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    s = trim_stats(df, ["x"], 0.02).first()
    assert s["n_kept"] == 10 and s["minimum"] == 1.0


def test_numeric_bins_agree_with_bucketizer(spark):
    vals = [None, 0.0, 1.5, 3.0, 3.0, 10.0, 100.0, float("nan"), 7.25] + [float(i % 13) for i in range(200)]
    got, m = bins_of(spark, vals, numeric=["x"])
    spec = m.numeric[((), "x")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    splits = [-math.inf] + spec.edges + [math.inf]
    b = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep").transform(df)
    ref = [None if r["b"] is None else int(r["b"]) + 1 for r in b.orderBy("i").collect()]
    ref = [0 if v is None else v for v in ref]
    assert got == ref


def test_frequency_index_rows(spark):
    got, _ = bins_of(spark, ["b", "a", "c", "c", None], "string", nominal=["x"])
    assert got == [2, 1, 0, 0, 3]


def test_frequency_index_agrees_with_string_indexer(spark, flow001):
    m = BinningModel.fit(flow001, only(boolean=BOOL_COLS, nominal=NOMINAL_COLS))
    ours = m.transform(flow001)
    for c in BOOL_COLS + NOMINAL_COLS:
        s = flow001.select("uid", F.col(c).cast("string").alias(c))
        ref = StringIndexer(inputCol=c, outputCol="r", handleInvalid="keep").fit(s).transform(s)
        j = ours.select("uid", f"{c}_bin").join(ref.select("uid", F.col("r").cast("int").alias("r")), "uid")
        assert j.where(F.col(f"{c}_bin") != F.col("r")).count() == 0, c


def test_nominal_all_null_is_zero(spark):
    got, _ = bins_of(spark, [None, None, None], "string", nominal=["x"], nominal_mode="coverage")
    assert got == [0, 0, 0]


def test_coverage_bin_rows(spark):
    # counts: a 5, b 3, c 1, d 1, e 1, f 1, g 1 ; coverage 0.5 -> first rank reaching 6.5 is 2
    vals = ["a"] * 5 + ["b"] * 3 + list("cdefg") + [None]
    got, m = bins_of(spark, vals, "string", nominal=["x"], nominal_mode="coverage", nominal_coverage=0.5)
    # j = max(2, min(5, 7)) = 5: ranks a1 b2 c3 d4 e5, others 6, null 0
    assert got == [1] * 5 + [2] * 3 + [3, 4, 5, 6, 6] + [0]


def test_ranking_matches_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"),
                                  (F.col("id") * 7919 % 5003).alias("v"), F.lit(2).alias("k"))
    kept = []
    got = {(r["g"], r["v"]): (r["rank"], r["cum"]) for r in rank_and_cumsum(df, ["g"], [F.col("v").asc()], sum_col="k", kept=kept).collect()}
    for t in kept:
        t.unpersist()
    w = Window.partitionBy("g").orderBy("v")
    ref = {(r["g"], r["v"]): (r["r"], 2 * r["r"]) for r in df.withColumn("r", F.row_number().over(w)).collect()}
    assert got == ref


def test_numeric_fit_does_not_depend_on_the_sketch(spark, flow001):
    a = fit_numeric(flow001, NUMERIC_COLS, 0.02)
    b = fit_numeric(flow001, NUMERIC_COLS, 0.02, accuracy=20)  # brackets a thousand times wider
    for key in a:
        assert a[key].n_kept == b[key].n_kept and a[key].minimum == b[key].minimum
        assert a[key].edges == pytest.approx(b[key].edges, rel=1e-9)


def test_lookup_paths_give_the_same_bins(spark, flow001):
    m = BinningModel.fit(flow001, only(nominal=["history", "service"]))
    whole = m.transform(flow001).select("uid", F.col("history_bin").alias("a"), F.col("service_bin").alias("b"))
    for most in (300, 60):  # some entries broadcast, or one
        part = m.transform(flow001, broadcast_bytes=most).select("uid", "history_bin", "service_bin")
        j = whole.join(part, "uid")
        assert j.count() == flow001.count()
        assert j.where((F.col("a") != F.col("history_bin")) | (F.col("b") != F.col("service_bin"))).count() == 0


def test_many_groups_and_groups_without_values(spark):
    rows = [(f"g{i % 100}", f"v{(i * 7) % 40}" if i % 100 else None, float(i % 17) if i % 100 else None) for i in range(8000)]
    df = spark.createDataFrame(rows, "g string, x string, y double")
    for mode in ("index", "coverage"):
        m = BinningModel.fit(df, only(nominal=["x"], numeric=["y"], nominal_mode=mode), by=["g"])
        out = m.transform(df)
        assert out.where("x_bin IS NULL OR y_bin IS NULL").count() == 0
        assert {tuple(r) for r in out.where("g = 'g0'").select("x_bin", "y_bin").distinct().collect()} == {(0, 0)}


def test_grouped_fit_equals_per_group_fit(spark, flow001):
    df = flow001.withColumn("grp", F.when(F.col("orig_pkts") < 25, "low").otherwise("high"))
    cfg = only(nominal=["history"], numeric=["duration"])
    grouped = BinningModel.fit(df, cfg, by=["grp"]).transform(df).select("uid", "history_bin", "duration_bin")
    for g in ("low", "high"):
        part = df.where(F.col("grp") == g)
        single = BinningModel.fit(part, cfg).transform(part).select(
            "uid", F.col("history_bin").alias("h"), F.col("duration_bin").alias("d"))
        j = single.join(grouped, "uid")
        assert j.count() == part.count()
        assert j.where((F.col("h") != F.col("history_bin")) | (F.col("d") != F.col("duration_bin"))).count() == 0


def test_full_bin_plan_has_no_python_and_no_single_partition(spark, flow001):
    m = BinningModel.fit(flow001)
    plan = m.transform(flow001)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan


def test_numeric_one_row_and_all_null_columns(spark):
    got, m = bins_of(spark, [None, 5.0, None], numeric=["x"])
    spec = m.numeric[((), "x")]
    assert spec.sd == 0.0 and spec.edges == [5.0] and got == [0, 2, 0]
    got, m = bins_of(spark, [None, None], numeric=["x"])
    assert m.numeric[((), "x")].edges == [] and got == [0, 0]


def test_all_distinct_column_shuffles_only_the_brackets(spark):
    """The exchanged rows of the numeric fit are a small share of the input."""
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    sc = spark.sparkContext
    rows = []
    import flowbin.operators.numeric as numeric

    ranked = numeric.rank_and_cumsum
    numeric.rank_and_cumsum = lambda hist, *a, **k: rows.append(hist.count()) or ranked(hist, *a, **k)
    try:
        spec = fit_numeric(df, ["x"])[((), "x")]
    finally:
        numeric.rank_and_cumsum = ranked
    assert spec.n_kept == n - 2 * int(n * 0.02) + 1
    assert rows and rows[0] < 0.05 * n
    assert sc._jsc.getPersistentRDDs().isEmpty()
