"""Feature vectors and tree models (M1, M3-M5) on MLlib."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 18 bins ranked for the feature-prefix ablation, and the prefix sizes.
FEATURE_RANKING = (
    "history_bin", "protocol_bin", "service_bin", "orig_bytes_bin", "dest_ip_bin",
    "orig_pkts_bin", "orig_ip_bytes_bin", "local_resp_bin", "dest_port_bin",
    "duration_bin", "conn_state_bin", "resp_pkts_bin", "resp_ip_bytes_bin",
    "src_port_bin", "resp_bytes_bin", "src_ip_bin", "local_orig_bin", "missed_bytes_bin",
)
PREFIX_SIZES = (18, 12, 9, 6)

#: The bound of :func:`rows_a_draw`, which no fit uses.
DRAWN_ROWS = 8_000_000
#: Rows of a fit that a task holds at most, and those that are worth a task of their own.
TASK_ROWS, FEW_ROWS = 250_000, 5_000
#: Rows that one row stands for while the rows of a fit are dealt out.
BLOCK = 1_024
#: Name of the column with the number of rows that a row of a fit stands for.
WEIGHT = "_fb_w"


def feature_columns(df: DataFrame, n: int, ranking: Sequence[str] = FEATURE_RANKING) -> list[str]:
    """The first ``n`` ranked features, listed in the table's column order."""
    wanted = set(ranking[:n])
    return [c for c in df.columns if c in wanted]


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def make_model(kind: str, label_col: str = "label_bin", features_col: str = "features", **params):
    if kind == "rf":
        return RandomForestClassifier(featuresCol=features_col, labelCol=label_col, **params)
    if kind == "gbt":
        return GBTClassifier(featuresCol=features_col, labelCol=label_col, **params)
    raise ValueError(f"unknown model {kind!r}")


def equal_rows(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., k): how many rows agree in all of ``cols``."""
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"))


def parts_of(spark: SparkSession, n: int) -> int:
    """Partitions of ``n`` rows for a fit or its scores, whatever their bytes."""
    return max(1, math.ceil(n / TASK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / FEW_ROWS)))


def single_rows(kind: str, params: dict) -> bool:
    """Whether a fit needs its rows one by one, which the size of the table does not change.

    Weights give the fit of the single rows where each row is used as it is.  A bootstrap (also
    that of a single tree) or a subsample draws rows, and a least number of rows a node counts them.
    """
    bagged = kind == "rf" and params.get("bootstrap", True)
    return bagged or params.get("subsamplingRate", 1.0) < 1.0 or params.get("minInstancesPerNode", 1) > 1


def rows_a_draw(kind: str, n_rows: int, params: dict) -> int | None:
    """Most equal rows a draw in a coarser bootstrap of ``DRAWN_ROWS`` draws; None for any number.

    Not for fits: its draws vary more than those of single rows, and change with the size of the
    table.  The sweep goes by :func:`single_rows`.
    """
    if params.get("minInstancesPerNode", 1) > 1:
        return 1
    bagged = kind == "rf" and params.get("bootstrap", True) and params.get("numTrees", 20) > 1
    if bagged or params.get("subsamplingRate", 1.0) < 1.0:
        return max(1, math.ceil(n_rows / DRAWN_ROWS))
    return None


def rows_to_fit(counted: DataFrame, cols: list[str], n_rows: int, n_equal: int, most: int | None, label_col: str = "label_bin") -> tuple[DataFrame, DataFrame]:
    """(label, cols..., WEIGHT): the ``n_rows`` rows counted in ``n_equal`` rows of ``counted``,
    and the kept table that they come from, for the caller to release.

    A row stands for at most ``most`` equal rows, and the weights add up to ``n_rows``.  The
    partitions and their order follow from the rows alone.
    """
    keys = [label_col, *cols]
    # a table of these columns alone is counted already
    same = counted if set(counted.columns) == {*keys, "k"} else counted.groupBy(*keys).agg(F.sum("k").alias("k"))
    n = n_equal if most is None else min(n_rows, n_rows // most + n_equal)
    pieces = F.lit(1).cast("long") if most is None else F.ceil(F.col("k") / F.lit(most))
    blocks = same.withColumn("_fb_m", pieces).withColumn("_fb_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_fb_m") - 1) / BLOCK))))
    # on disk: the memory is for the fit's own rows
    dealt = blocks.repartition(parts_of(counted.sparkSession, n), *keys, "_fb_at").sortWithinPartitions(*keys, "_fb_at").persist(StorageLevel.DISK_ONLY)
    here = F.least(F.lit(BLOCK), F.col("_fb_m") - F.col("_fb_at") * BLOCK).cast("int")
    weight = F.col("k") / F.col("_fb_m")
    return dealt.select(*keys, F.explode(F.array_repeat(weight, here)).alias(WEIGHT)), dealt


def fit_model(kind: str, train: DataFrame, cols: list[str], label_col: str = "label_bin", weight_col: str | None = None, **params):
    """A model of the columns ``cols``; the rows that the fit reads hold these, the label and the weight only."""
    kept = [label_col, *([weight_col] if weight_col else [])]
    rows = assemble(train.select(*kept, *cols), cols).select(*kept, "features")
    return make_model(kind, label_col, **({"weightCol": weight_col} if weight_col else {}), **params).fit(rows)


def score_models(models: dict, test: DataFrame, label_col: str = "label_bin", count_col: str | None = None) -> dict:
    """The confusion cells (label, prediction, n) of every fitted model, from one pass over ``test``.

    ``models`` has (model, columns) by any key.  All models are applied to the row as it is
    scanned; their predictions are unpivoted and counted in one aggregate of models times
    classes^2 rows.  With ``count_col`` a row stands for that many.
    """
    if not models:
        return {}
    cols = sorted({c for _, used in models.values() for c in used}, key=test.columns.index)
    kept = [label_col, *([count_col] if count_col else [])]
    rows = test.select(*kept, *cols)
    vectors: dict[tuple, str] = {}
    for _, used in models.values():
        if tuple(used) not in vectors:
            vectors[tuple(used)] = f"_fb_x{len(vectors)}"
            rows = assemble(rows, used, vectors[tuple(used)])
    keep_cols, keys = [*kept, *vectors.values()], list(models)
    for i, key in enumerate(keys):
        model, used = models[key]
        scorer = model.copy().setFeaturesCol(vectors[tuple(used)]).setPredictionCol(f"_fb_p{i}").setRawPredictionCol("").setProbabilityCol("")
        keep_cols.append(f"_fb_p{i}")
        rows = scorer.transform(rows).select(*keep_cols)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_fb_p{i}").alias("prediction")) for i in range(len(keys))]))
    n = F.col(count_col) if count_col else F.lit(1)
    cells = rows.select(F.col(label_col).alias("label"), n.cast("long").alias("n"), each).groupBy("i", "label", "prediction").agg(F.sum("n").alias("n"))
    out: dict = {key: [] for key in keys}
    for r in cells.collect():  # models x classes^2 rows
        out[keys[r["i"]]].append(r)
    return out
