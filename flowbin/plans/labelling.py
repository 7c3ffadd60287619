"""Class labels for a task table (R7, R8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.functions.labels import binary_label
from flowbin.operators.binning import BinningConfig, BinningModel
from flowbin.sources.schema import BENIGN, LABEL_COL


def add_binary_label(df: DataFrame, label_col: str = LABEL_COL, benign: str = BENIGN,
                     out: str = "label_bin") -> DataFrame:
    """Attack 0.0, benign (and null label) 1.0."""
    return df.withColumn(out, binary_label(label_col, benign))


def add_multiclass_label(df: DataFrame, label_col: str = LABEL_COL, by: list[str] | None = None,
                         out: str = "label_bin") -> DataFrame:
    """Frequency rank of the label with full coverage: most frequent class 1.0,
    null label 0.0; adds ``<label>_bin`` (int) and ``out`` (double)."""
    config = BinningConfig(ip=[], port=[], boolean=[], nominal=[], numeric=[], extra_coverage={label_col: 1.0})
    res = BinningModel.fit(df, config, by=by).transform(df)
    return res.withColumn(out, F.col(label_col + "_bin").cast("double"))
