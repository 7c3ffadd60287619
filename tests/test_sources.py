"""Sources and sinks: rename check, CSV flow scan, results sink."""

import tempfile

import pytest
from pyspark.sql import functions as F

from flowbin.sources import fixtures
from flowbin.sources.results import RESULTS, append_results, read_flows, results_frame
from flowbin.sources.schema import FLOW, FLOW_RAW, MissingColumnsError, rename_flow
from paths import SF001


def test_rename_checks_all_columns_at_once(spark):
    raw = fixtures.conn(spark, SF001)
    shape = [(f.name, f.dataType) for f in rename_flow(raw).schema]
    assert shape == [(f.name, f.dataType) for f in FLOW]
    with pytest.raises(MissingColumnsError) as e:
        rename_flow(raw.drop("proto", "ts"))
    assert "proto" in str(e.value) and "ts" in str(e.value)


def test_csv_flow_scan_round_trip(spark):
    path = tempfile.mkdtemp(prefix="flowbin-csv-", dir="/tmp") + "/flows"
    raw = fixtures.conn(spark, SF001)
    raw.write.option("header", True).csv(path)
    typed = read_flows(spark, path, "csv")
    assert typed.schema == FLOW_RAW
    assert typed.exceptAll(raw).count() == 0 and raw.exceptAll(typed).count() == 0
    inferred = read_flows(spark, path, "csv", infer=True)
    assert set(inferred.columns) == set(FLOW_RAW.names)
    assert inferred.count() == raw.count()


def test_results_sink_parquet_and_csv(spark):
    rows = [("10:00:00", "d", "Discovery", "rf", 0.3, 2, ["a_bin", "b_bin"], [[1.0, 2.0], [3.0, 4.0]],
             0.5, 0.4, 0.3, 0.35, 0.6, 0.3, 0.1, 1.0, 2.0, 0.5, [3, 2])]
    res = results_frame(spark, rows)
    assert res.schema == RESULTS
    base = tempfile.mkdtemp(prefix="flowbin-res-", dir="/tmp")
    append_results(res, base + "/pq")
    append_results(res, base + "/pq")
    assert spark.read.parquet(base + "/pq").count() == 2
    append_results(res, base + "/csv", fmt="csv")
    back = spark.read.option("header", True).csv(base + "/csv")
    r = back.first()
    assert r["feature_list"] == "a_bin b_bin" and r["matrix_json"] == "[[1.0,2.0],[3.0,4.0]]"


def test_csv_scan_goes_by_header_names(spark):
    base = tempfile.mkdtemp(prefix="flowbin-csv-", dir="/tmp")
    raw = fixtures.conn(spark, SF001)
    turned = raw.select(F.lit("more").alias("extra"), *reversed(raw.columns))
    turned.write.option("header", True).csv(base + "/turned")
    back = read_flows(spark, base + "/turned", "csv")
    assert set(back.columns) == {"extra", *FLOW_RAW.names}
    typed = back.select(*FLOW_RAW.names)
    assert typed.schema == FLOW_RAW
    assert typed.exceptAll(raw).count() == 0 and raw.exceptAll(typed).count() == 0
    raw.drop("proto").write.option("header", True).csv(base + "/short")
    with pytest.raises(MissingColumnsError, match="proto"):
        read_flows(spark, base + "/short", "csv")


def test_csv_cells_that_do_not_parse_are_reported(spark):
    base = tempfile.mkdtemp(prefix="flowbin-csv-", dir="/tmp") + "/bad"
    raw = fixtures.conn(spark, SF001).limit(5)
    text = raw.select(*[F.when(F.col("uid") == raw.first()["uid"], F.lit("x7")).otherwise(F.col(c).cast("string")).alias(c)
                        if c == "orig_pkts" else F.col(c) for c in raw.columns])
    text.coalesce(1).write.option("header", True).csv(base)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_flows(spark, base, "csv").collect()
    rows = read_flows(spark, base, "csv", on_bad="column").collect()
    assert [r["_bad_record"] is not None for r in rows].count(True) == 1
    assert read_flows(spark, base, "csv", on_bad="null").where("orig_pkts IS NULL").count() == 1
