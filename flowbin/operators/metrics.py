"""Confusion table and per-class metrics as DataFrame aggregates (M6-M13).

The confusion table has at most classes^2 rows; every metric is arithmetic on
it, so all metrics of a run are one small job and nothing goes through RDDs.
Definitions for the positive label ``p`` (1.0 by default):

* accuracy  = correct / total
* precision = tp / (tp + fp), 0 when nothing is predicted ``p``
* recall    = tp / (tp + fn) = true-positive rate (null without positives)
* f_measure = 2 tp / (2 tp + fp + fn), 0 when tp = 0
* false_positive = fp / (fp + tn) (null without negatives)
* auc_hard  = (tpr + 1 - fpr) / 2: the ROC area of 0/1 predictions
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, label_col: str = "label_bin", pred_col: str = "prediction") -> DataFrame:
    """Long-form confusion table (label, prediction, n)."""
    return pred.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(num.cast("double") / den.cast("double"))


def class_metrics(pred: DataFrame, positive: float = 1.0, label_col: str = "label_bin",
                  pred_col: str = "prediction", digits: int | None = None) -> DataFrame:
    """One row: n, accuracy, precision, recall, f_measure, true_positive, false_positive, auc_hard."""
    return metrics_from_confusion(confusion(pred, label_col, pred_col), positive, digits)


def metrics_from_confusion(cm: DataFrame, positive: float = 1.0, digits: int | None = None) -> DataFrame:
    """All metrics from a confusion table (label, prediction, n)."""
    p = F.lit(float(positive))
    is_l, is_p = F.col("label") == p, F.col("prediction") == p
    n = F.col("n")
    agg = cm.agg(
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("label") == F.col("prediction"), n).otherwise(0)).alias("correct"),
        F.sum(F.when(is_l & is_p, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~is_l & is_p, n).otherwise(0)).alias("fp"),
        F.sum(F.when(is_l & ~is_p, n).otherwise(0)).alias("fn"),
        F.sum(F.when(~is_l & ~is_p, n).otherwise(0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tpr = _safe_div(tp, tp + fn)
    fpr = _safe_div(fp, fp + tn)
    out = agg.select(
        F.col("total").alias("n"),
        _safe_div(F.col("correct"), F.col("total")).alias("accuracy"),
        F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp)).alias("precision"),
        tpr.alias("recall"),
        F.when(tp == 0, F.lit(0.0)).otherwise((2.0 * tp) / (2.0 * tp + fp + fn)).alias("f_measure"),
        tpr.alias("true_positive"),
        fpr.alias("false_positive"),
        ((tpr + F.lit(1.0) - fpr) / F.lit(2.0)).alias("auc_hard"),
    )
    if digits is not None:
        out = out.select("n", *[F.round(c, digits).alias(c) for c in out.columns if c != "n"])
    return out


def auc_hard(pred: DataFrame, positive: float = 1.0, label_col: str = "label_bin",
             pred_col: str = "prediction", digits: int | None = None) -> DataFrame:
    """ROC area of hard 0/1 predictions, one row."""
    m = class_metrics(pred, positive, label_col, pred_col, digits)
    return m.select("auc_hard")


def confusion_matrix(cm_rows, labels: list[float] | None = None) -> list[list[float]]:
    """Dense matrix (rows actual, columns predicted, labels ascending) from a
    collected confusion table (at most classes^2 rows).

    The classes are the actual labels, as MLlib's ``MulticlassMetrics`` has them: a
    class that is only ever predicted has no row or column, its cells are left out.
    """
    cells = {(float(r["label"]), float(r["prediction"])): float(r["n"]) for r in cm_rows}
    labels = labels or sorted({a for a, _ in cells})
    return [[cells.get((a, p), 0.0) for p in labels] for a in labels]
