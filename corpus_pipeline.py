"""From raw documents to training data: quality rules, near-dedup, substring dedup, benchmark
decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the docs of the next.  All but the last return the columns of ``documents``.
Since the result of the stage before is written by then, a stage begins by deleting the
scratch tables that earlier stages of this thread made, and no others.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbin.llm import decontam, fertility, orderminhash, pieces, substrings
from flowbin.llm.frames import delete, owned
from flowbin.session import shared_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_left = threading.local()


def _stage(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with scratch tables of its own, deleted when the thread's next stage begins."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, getattr(_left, "paths", []))
        with owned() as _left.paths:
            return stage(spark, docs, sf_dir)
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep."""
    return fertility.keep_good(docs.select(COLUMNS))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return orderminhash.keep_first(docs.select(COLUMNS))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows that a smaller document has; n_chars follows the new text.
    Documents of which no word is left go."""
    out = substrings.remove_repeats(docs.select(COLUMNS))
    left = out.where("repeats.n_removed = 0 OR repeats.n_removed < repeats.n_words")
    n_chars = F.when(F.col("repeats.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(COLUMNS)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether these decode to the text."""
    out = pieces.encode(docs.select(COLUMNS), check=True)
    whole = F.coalesce(F.col("text"), F.lit(""))
    return out.select(*COLUMNS, F.col("pieces.ids").alias("ids"), F.size("pieces.ids").cast("long").alias("n_pieces"),
                      F.col("pieces.score").alias("score"), (F.col("pieces.decoded") == whole).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("piece_encoding", piece_encoding),
]

#: The vocabularies, sketches and the Viterbi are not SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    base = shared_scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
