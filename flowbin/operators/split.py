"""Train/test split (R6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.functions.labels import hash_unit
from flowbin.sources.schema import ID_COL

#: md5 bits 33-64 of the id; the benign sample uses bits 1-32.
SPLIT_HASH_PART = 1


def split_flag(train_share: float = 0.7, id_col: str = ID_COL):
    """'train' when the id's hash unit is below ``train_share``, else 'test'."""
    return F.when(hash_unit(id_col, SPLIT_HASH_PART) < F.lit(float(train_share)), F.lit("train")).otherwise(F.lit("test"))


def hash_split(df: DataFrame, train_share: float = 0.7, id_col: str = ID_COL) -> tuple[DataFrame, DataFrame]:
    """Deterministic split on the id: same rows whatever the partitioning.

    Copies of a row (replicated benign rows) share their id and so their side.
    A row without an id goes to the test side, so no row is lost.
    """
    in_train = F.coalesce(hash_unit(id_col, SPLIT_HASH_PART) < F.lit(float(train_share)), F.lit(False))
    return df.where(in_train), df.where(~in_train)


def random_split(df: DataFrame, train_share: float = 0.7, seed: int = 2057) -> tuple[DataFrame, DataFrame]:
    """Spark's ``randomSplit`` (depends on partitioning and row order)."""
    train, test = df.randomSplit([train_share, 1.0 - train_share], seed=seed)
    return train, test
