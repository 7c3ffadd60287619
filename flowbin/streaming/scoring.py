"""Binning and scoring of streaming flow records with fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowbin.operators.binning import BinningModel
from flowbin.operators.models import assemble


def bin_stream(model: BinningModel, stream: DataFrame, replace: bool = False) -> DataFrame:
    """Bins of a streaming DataFrame with statistics fitted on a batch table."""
    if not stream.isStreaming:
        raise ValueError("bin_stream expects a streaming DataFrame (spark.readStream)")
    return model.transform(stream, replace=replace)


def score_stream(model: BinningModel, classifier, feature_cols: list[str], stream: DataFrame,
                 keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Bins -> feature vector -> prediction for each arriving row."""
    binned = bin_stream(model, stream)
    pred = classifier.transform(assemble(binned, feature_cols))
    return pred.select(*keep, "prediction")
