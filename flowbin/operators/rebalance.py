"""Label counts, top-n tactics, benign quota and the one-vs-benign task table.

Instead of a dict of DataFrames (one per tactic), tasks live in **one** long
DataFrame with a ``task`` column.  Label counts are one aggregation; the plan
(one row per task, at most ``num_top_labels`` rows) is computed on the driver
from those counts; then attack rows and benign rows are each read once:

* attack rows of a top tactic keep their row, tagged with the task;
* every benign row is emitted ``copies + [hash(uid) < frac]`` times per task
  (whole-table replication plus a Bernoulli sample), by exploding a small
  literal array - no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbin.functions.labels import row_unit
from flowbin.sources.schema import BENIGN, ID_COL, LABEL_COL

# The name of the single multi-class task, the two tactics the
# binary front end keeps, and the smallest task that is analysed.
ALL_TASK = "All label techniques"
DEFAULT_TACTICS = ("Reconnaissance", "Discovery")
MIN_TASK_ROWS = 500


def label_counts(df: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """(label, n) over all rows, null label included as its own group."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def top_labels(df: DataFrame, n: int, label_col: str = LABEL_COL, benign: str = BENIGN) -> DataFrame:
    """The ``n`` most frequent non-benign labels (ties by label), as (label, n).

    A null label is neither benign nor an attack: ``!=`` with null is not true.
    """
    return (
        label_counts(df, label_col)
        .where(F.col(label_col) != F.lit(benign))
        .orderBy(F.col("n").desc(), F.col(label_col).asc())
        .limit(n)
    )


def benign_quota(attack_rows: float, attack_pct: float) -> float:
    """Benign rows needed so attacks are ``attack_pct`` of the task."""
    if attack_pct <= 0.0 or attack_pct > 1.0:
        raise ValueError("invalid attack share: need 0.0 < attack_pct <= 1.0")
    return ((1.0 - attack_pct) * attack_rows) / attack_pct


def benign_quota_col(attack_rows: Column, attack_pct: float) -> Column:
    benign_quota(1.0, attack_pct)  # validates the share
    return ((F.lit(1.0) - F.lit(attack_pct)) * attack_rows.cast("double")) / F.lit(attack_pct)


def rebalance_plan(df: DataFrame, attack_pct: float, num_top_labels: int,
                   label_col: str = LABEL_COL, benign: str = BENIGN) -> DataFrame:
    """(task, attack_rows, benign_rows, quota, frac, copies): one row per top tactic.

    ``copies`` whole benign tables plus a ``frac`` sample give ``quota`` benign
    rows in expectation.
    """
    counts = label_counts(df, label_col)
    label = F.col(label_col)
    # benign first, then attacks by count (null label last): the benign count
    # and the top tactics come from one top-(n+1), so the window below sees at
    # most num_top_labels + 1 rows
    order = F.when(label == F.lit(benign), 0).when(label.isNotNull(), 1).otherwise(2)
    head = counts.orderBy(order, F.col("n").desc(), label.asc()).limit(num_top_labels + 1)
    with_nb = head.withColumn(
        "benign_rows",
        F.coalesce(F.max(F.when(label == F.lit(benign), F.col("n"))).over(Window.partitionBy()),
                   F.lit(0)),
    )
    top = (with_nb.where(label != F.lit(benign))
           .orderBy(F.col("n").desc(), label.asc()).limit(num_top_labels))
    quota = benign_quota_col(F.col("attack_rows"), attack_pct)
    nb = F.col("benign_rows")
    return top.select(
        F.col(label_col).alias("task"), F.col("n").alias("attack_rows"), "benign_rows",
    ).select(
        "task", "attack_rows", "benign_rows", quota.alias("quota"),
        F.when(nb > 0, (quota % nb) / nb).alias("frac"),
        F.when(nb > 0, F.floor(F.floor(quota) / nb)).cast("bigint").alias("copies"),
    )


def rebalance(df: DataFrame, attack_pct: float, num_top_labels: int,
              label_col: str = LABEL_COL, benign: str = BENIGN, id_col: str = ID_COL,
              seed_part: int = 0, keep: Sequence[str] | None = None,
              sampler: str = "hash", seed: int = 1234) -> DataFrame:
    """One long table: ``task`` + the input columns, one block per top tactic.

    One scan and one generator: each input row becomes the list of tasks it
    belongs to (its own tactic, or for a benign row every task repeated
    ``copies + [sampled]`` times), then that list is exploded.

    ``keep`` restricts the output to some of the top tactics (every name must
    be one of them); rows of other tasks are never generated.  ``sampler``
    picks the benign sample: ``"hash"`` (default, a fixed subset per ``uid``,
    independent of partitioning) or ``"bernoulli"`` (``rand(seed)``, like
    ``DataFrame.sample``; depends on partitioning and row order).
    """
    benign_quota(1.0, attack_pct)
    if sampler not in ("hash", "bernoulli"):
        raise ValueError(f"unknown sampler {sampler!r}")
    plan = rebalance_plan(df, attack_pct, num_top_labels, label_col, benign).collect()
    if keep is not None:
        known = {r["task"] for r in plan}
        missing = [t for t in keep if t not in known]
        if missing:
            raise KeyError("unknown task(s): " + ", ".join(missing))
        plan = [r for r in plan if r["task"] in set(keep)]
    if not plan:
        return df.select(F.lit(None).cast("string").alias("task"), *df.columns).limit(0)
    if not plan[0]["benign_rows"]:
        raise ValueError(f"no benign rows (label {benign!r}) to rebalance with")
    # bounded by num_top_labels: the plan rides along as literals
    tasks = [r["task"] for r in plan]
    u = F.col("_fb_u")
    benign_tasks = F.flatten(F.array(*[
        F.array_repeat(F.lit(r["task"]),
                       (F.lit(int(r["copies"])) + F.when(u < F.lit(float(r["frac"])), 1).otherwise(0))
                       .cast("int"))
        for r in plan
    ]))
    label = F.col(label_col)
    row_tasks = (F.when(label == F.lit(benign), benign_tasks)
                 .when(label.isin(tasks), F.array(label))
                 .otherwise(F.array().cast("array<string>")))
    draw = row_unit(df, id_col, seed_part) if sampler == "hash" else F.rand(seed)
    # the draw is computed once per row, before the generator
    with_u = df.select("*", F.when(label == F.lit(benign), draw).alias("_fb_u"))
    return with_u.select(F.explode(row_tasks).alias("task"), *df.columns)


def task_counts(tasks: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """(task, label, n, task_total): per-task label counts with the task total."""
    per = tasks.groupBy("task", label_col).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("task_total", F.sum("n").over(Window.partitionBy("task")))


def gate_tasks(tasks: DataFrame, min_rows: int = MIN_TASK_ROWS) -> DataFrame:
    """Drop whole tasks with fewer than ``min_rows`` rows (left-semi on a task table)."""
    sizes = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    # one row per task: bounded by the number of tasks
    return tasks.join(F.broadcast(sizes.select("task")), "task", "left_semi")


def make_tasks(df: DataFrame, binary: bool, attack_pct: float = 0.3, num_top_labels: int = 10,
               tactics: Sequence[str] | None = DEFAULT_TACTICS, label_col: str = LABEL_COL,
               benign: str = BENIGN, sampler: str = "hash") -> DataFrame:
    """Binary: rebalanced one-vs-benign tasks (optionally only ``tactics``);
    multi-class: the whole table as the single task ``All label techniques``."""
    if not binary:
        return df.select(F.lit(ALL_TASK).alias("task"), *df.columns)
    return rebalance(df, attack_pct, num_top_labels, label_col, benign,
                     keep=list(tactics) if tactics else None, sampler=sampler)
