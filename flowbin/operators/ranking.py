"""Row numbers and running sums over a total order, without one giant task.

``row_number() OVER (ORDER BY ...)`` without ``PARTITION BY`` plans an
``Exchange SinglePartition``: every row goes to one task.  Here the rows are
range-partitioned on the ordering, numbered inside each range partition, and
shifted by the sizes of the preceding partitions, which come from a table with
one row per (group, partition).  There is one path for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbin.session import keep


def _join_cond(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def rank_and_cumsum(
    df: DataFrame,
    part_cols: list[str],
    order_cols: list[Column],
    sum_col: str | None = None,
    rank_col: str = "rank",
    cum_col: str = "cum",
    kept: list | None = None,
) -> DataFrame:
    """Add a 1-based ``rank_col`` (and inclusive running sum of ``sum_col``).

    ``order_cols`` must be a strict total order inside each ``part_cols``
    group (callers add the value as the last tie-break).  The range-partitioned
    copy is kept, since its partition ids must not change between the two
    reads; it is appended to ``kept`` so that the caller can release it.
    """
    ranged = keep(
        df.repartitionByRange(*[F.col(c) for c in part_cols], *order_cols)
        .withColumn("_pid", F.spark_partition_id()), eager=False)
    if kept is not None:
        kept.append(ranged)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if sum_col is not None:
        aggs.append(F.sum(sum_col).alias("_s"))
    sizes = ranged.groupBy(*part_cols, "_pid").agg(*aggs)
    before = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("_off_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if sum_col is not None:
        offs = offs.withColumn("_off_s", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    offs = offs.drop("_n", "_s")

    local_w = Window.partitionBy(*part_cols, "_pid").orderBy(*order_cols)
    local = ranged.withColumn("_lrn", F.row_number().over(local_w))
    if sum_col is not None:
        local = local.withColumn(
            "_lcum", F.sum(sum_col).over(local_w.rowsBetween(Window.unboundedPreceding, 0))
        )
    joined = local.join(offs, _join_cond(local, offs, part_cols + ["_pid"]))
    return joined.select(
        *[local[c] for c in df.columns],
        (local["_lrn"] + offs["_off_n"]).cast("int").alias(rank_col),
        *([(local["_lcum"] + offs["_off_s"]).alias(cum_col)] if sum_col is not None else []),
    )
