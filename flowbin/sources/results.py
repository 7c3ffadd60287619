"""Typed results table: one row per (task, feature prefix, model) run (S2, S3)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbin.sources.splits import read_parquet
from flowbin.sources.schema import FLOW_RAW, RENAME_MAP, require_columns

RESULTS = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("pct_attack", T.DoubleType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("feature_cols", T.ArrayType(T.StringType())),
    T.StructField("cfsn_mtrx", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f_measure", T.DoubleType()),
    T.StructField("area_under_curve", T.DoubleType()),
    T.StructField("true_positive", T.DoubleType()),
    T.StructField("false_positive", T.DoubleType()),
    T.StructField("bin_time", T.DoubleType()),
    T.StructField("train_time", T.DoubleType()),
    T.StructField("test_time", T.DoubleType()),
    T.StructField("train_distinct", T.ArrayType(T.LongType())),  # values of each feature in the training rows
])


def results_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Build the results table from per-run records (one per run: a short list)."""
    return spark.createDataFrame(rows, RESULTS)


def append_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append runs to a results folder (parquet by default; CSV with a header)."""
    w = results.coalesce(1).write.mode("append")
    if fmt == "csv":
        flat = results.selectExpr(
            "*", "concat_ws(' ', feature_cols) AS feature_list",
            "to_json(cfsn_mtrx) AS matrix_json",
            "to_json(train_distinct) AS distinct_json").drop("feature_cols", "cfsn_mtrx", "train_distinct")
        flat.coalesce(1).write.mode("append").option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


class ResultsSink:
    """Results of sweeps, one committed folder a fit: ``path/run_key=.../fit=...``.

    A fit's name and so its folder follow from what was fitted.  A row is written there with
    Spark's commit protocol and counts once the success marker is there: a sweep that broke in
    the middle of a write leaves none, and the row is written again in place.  So no row is lost
    or there twice, however often a sweep is restarted.
    """

    def __init__(self, spark: SparkSession, path: str, run_key: str):
        self.spark, self.path, self.run_key = spark, path.rstrip("/"), run_key

    @staticmethod
    def name(task: str, model: str, n: int) -> str:
        """A fit's folder: readable, and told apart by a hash where names need changing."""
        digest = hashlib.sha256(task.encode()).hexdigest()[:8]
        return f"{re.sub('[^A-Za-z0-9]+', '-', task)[:40]}-{digest}-{model}-{n}"

    def committed(self) -> dict[str, tuple]:
        """Rows of this sweep by the names of their fits."""
        jvm = self.spark.sparkContext._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_key={self.run_key}/fit=*/_SUCCESS")
        fs = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(s.getPath().getParent()) for s in fs.globStatus(glob) or []]
        if not found:
            return {}
        rows = self.spark.read.schema(RESULTS).parquet(*found).withColumn("_at", F.col("_metadata.file_path")).collect()  # one a fit
        return {re.search("/fit=([^/]+)/", r["_at"])[1]: tuple(r)[:-1] for r in rows}

    def commit(self, name: str, row: tuple) -> None:
        """Write the row of a fit, in place of what a broken write left."""
        results_frame(self.spark, [row]).coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
            f"{self.path}/run_key={self.run_key}/fit={name}")


#: Column that holds the text of a record with cells that do not parse.
BAD_RECORD = "_bad_record"


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet", infer: bool = False,
               on_bad: str = "fail") -> DataFrame:
    """Scan raw flow files; few large row groups of Parquet are dealt out over the cores.

    A CSV scan goes by the header's names: all flow columns must be there
    (MissingColumnsError names those that are not), in any order, and further
    columns come as strings.  Files with another header than the first fail.
    Cells that do not parse fail the scan (``on_bad="fail"``), keep the
    record's text in a column ``_bad_record`` (``"column"``), or are null
    (``"null"``).  ``infer`` infers the types instead, at the cost of a full
    extra pass over the text.
    """
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if on_bad not in ("fail", "column", "null"):
        raise ValueError(f"unknown on_bad {on_bad!r}")
    header = spark.read.option("header", True).csv(path)  # reads the first line
    require_columns(header, RENAME_MAP)
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    known = {f.name: f for f in FLOW_RAW.fields}
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in header.columns]
    if on_bad == "column":
        fields.append(T.StructField(BAD_RECORD, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    mode = "FAILFAST" if on_bad == "fail" else "PERMISSIVE"
    return reader.option("mode", mode).option("enforceSchema", False).schema(T.StructType(fields)).csv(path)
