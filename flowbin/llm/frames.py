"""Shared frame helpers: fixed working columns whatever the input's names, and shared scratch tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbin.session import remove_path, shared_scratch


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@dataclass
class Packed:
    """``rows`` has id, text and a struct ``rest`` of all other input columns by position."""

    rows: DataFrame
    source: DataFrame
    id_col: str
    text_col: str
    result: str

    def unpack(self, frame: DataFrame, result: Column) -> DataFrame:
        """The input's columns in their order and types, and ``result`` as the named column."""
        out, i = [], 0
        for c in self.source.columns:
            if c == self.id_col:
                out.append(F.col("id").cast(self.source.schema[c].dataType).alias(c))
            elif c == self.text_col:
                out.append(F.col("text").alias(c))
            elif c != self.result:
                out.append(F.col(f"rest.c{i}").alias(c))
                i += 1
        return frame.select(*out, result.alias(self.result))


def pack(docs: DataFrame, id_col: str, text_col: str, result: str) -> Packed:
    """Rename to working columns.  A column called ``result`` in the input will be replaced.

    Texts are wide rows: unless the session has its own setting, they go to Python a
    thousand at a time, which bounds the Arrow buffers on both sides.
    """
    conf = docs.sparkSession.conf
    if conf.get(_BATCH_ROWS) == "10000":  # Spark's default
        conf.set(_BATCH_ROWS, "1000")
    others = [c for c in docs.columns if c not in (id_col, text_col, result)]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("fill"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), rest.alias("rest"))
    return Packed(rows, docs, id_col, text_col, result)


def settle(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the cluster's shared folder (spark.checkpoint.dir) and read it back, lineage cut."""
    spark = frame.sparkSession
    path = shared_scratch(spark, "table")
    owner = _owner.get()
    if owner is not None:
        owner.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the paths of the tables settled inside, and of no others.

    Their owner may :func:`delete` them once its results are written; frames that still read
    them fail then.  Tables that nobody owns stay.
    """
    paths: list[str] = []
    token = _owner.set(paths)
    try:
        yield paths
    finally:
        _owner.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        remove_path(spark, paths.pop())
