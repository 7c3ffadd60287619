"""The experiment sweep (M2, M15): tasks x feature prefixes x models -> results.

Tasks are one long DataFrame; labels and binning are fitted for all tasks together (grouped by
``task``).  The sizes for the gate come out of the binning's own counts and take no pass.
(``DataFrame.observe`` would give them too, but a session that has observed once can no longer
ship MLlib models with a training summary to its tasks.)  The narrow binned table is Parquet laid
out by task, and read once a task: rows that agree in label and all features are counted, and fits,
scores and distinct values work on the counts.  The models of a task
are fitted a few at a time in scheduler pools of their own, then one pass over the task's test
rows applies all of them.  With a results path every finished fit is committed under the run's
key: a restarted sweep skips it.
"""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.functions.labels import hash_unit
from flowbin.operators.binning import BinningConfig, BinningModel
from flowbin.operators.metrics import confusion_matrix, metrics_from_confusion
from flowbin.operators.models import PREFIX_SIZES, WEIGHT, equal_rows, feature_columns, fit_model, parts_of, rows_to_fit, score_models, single_rows
from flowbin.operators.rebalance import MIN_TASK_ROWS, make_tasks
from flowbin.operators.split import SPLIT_HASH_PART, random_split, split_flag
from flowbin.plans.labelling import add_binary_label, add_multiclass_label
from flowbin.session import materialize, remove_path, shared_scratch, store
from flowbin.sources.schema import ID_COL, LABEL_COL
from flowbin.sources.results import ResultsSink, results_frame

#: Models that are fitted at once.
PARALLEL_FITS = 3


def distinct_state(df: DataFrame, cols: list[str], by: Sequence[str] = (), approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """(by..., cname, u): distinct non-null values of each column, in one pass for all groups.

    Exact counts group the unpivoted (column, value) pairs, which the map-side partial aggregate
    collapses; ``approx=True`` uses HyperLogLog++ sketches (fixed memory).
    """
    items = [F.struct(F.lit(c).alias("cname"), F.col(c).cast("string").alias("v")) for c in cols]
    long = df.select(*by, F.inline(F.array(*items)))
    if approx:
        return long.groupBy(*by, "cname").agg(F.approx_count_distinct("v", rsd).alias("u"))
    values = long.where("v IS NOT NULL").groupBy(*by, "cname", "v").agg(F.count(F.lit(1)).alias("k"))
    return values.groupBy(*by, "cname").agg(F.count(F.lit(1)).alias("u"))


def feature_distinct_counts(df: DataFrame, cols: list[str], approx: bool = False,
                            rsd: float = 0.01) -> DataFrame:
    """One row: the number of distinct values of each column."""
    sizes = distinct_state(df, cols, approx=approx, rsd=rsd)
    return sizes.agg(*[F.coalesce(F.max(F.when(F.col("cname") == c, F.col("u"))), F.lit(0)).alias(c) for c in cols])


def check_models(models: Sequence[str], binary: bool) -> None:
    """Raise before any job if a model does not exist or cannot learn the labels."""
    for kind in models:
        if kind not in ("rf", "gbt"):
            raise ValueError(f"unknown model {kind!r}")
        if kind == "gbt" and not binary:
            raise ValueError("gradient-boosted trees need labels 0.0 / 1.0 (binary tasks only)")


@dataclasses.dataclass
class Prepared:
    """The binned rows of all tasks: Parquet by task with a flag of the training side."""

    path: str
    rows: DataFrame
    model: BinningModel
    seconds: float
    tasks: list[str]

    def task(self, name: str) -> DataFrame:
        return self.rows.where(F.col("task") == name)

    def release(self) -> None:
        remove_path(self.rows.sparkSession, self.path)
        self.model.release()


def prepare_tasks(flows: DataFrame, binary: bool, attack_pct: float = 0.3, num_top_labels: int = 10,
                  tactics: Sequence[str] | None = None, min_rows: int = MIN_TASK_ROWS,
                  config: BinningConfig | None = None, fit_bins_on: str = "all",
                  train_share: float = 0.7, sampler: str = "hash") -> Prepared:
    """Tasks -> label -> bins -> gate for all tasks.

    ``fit_bins_on="all"`` fits the bin statistics on every row of a task, as
    the reference does (test rows leak into the edges); ``"train"`` fits them
    on the rows the hash split will put in the training set.

    The task table is not kept: rebalancing is map-only and the hash sample
    is fixed per row, so each pass re-derives it from the flow scan and Catalyst
    reads only the columns that pass needs.  Only a Bernoulli sample, whose
    draws must not change between passes, is kept.  Tasks below the gate are
    fitted with the others, since their sizes are known from the fit's counts,
    and are not written.
    """
    if fit_bins_on not in ("all", "train"):
        raise ValueError(f"fit_bins_on must be 'all' or 'train', not {fit_bins_on!r}")
    spark = flows.sparkSession
    tasks = make_tasks(flows, binary, attack_pct, num_top_labels, tactics, sampler=sampler)
    if sampler == "bernoulli":
        tasks = materialize(tasks)
    t0 = time.perf_counter()
    config = config or BinningConfig()
    if binary:
        labelled = add_binary_label(tasks)
    elif fit_bins_on == "all":
        # the multi-class label rank comes from the binning model's own counts
        config = dataclasses.replace(config, extra_coverage={**config.extra_coverage, LABEL_COL: 1.0})
        labelled = tasks
    else:
        labelled = add_multiclass_label(tasks, by=["task"])
    if fit_bins_on == "all":
        model = BinningModel.fit(labelled, config, by=["task"])
        sizes = model.group_rows()
    else:
        model = BinningModel.fit(labelled.where(split_flag(train_share) == "train"), config, by=["task"], groups_of=labelled)
        sizes = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n"))  # the fit has seen the training rows only
    kept = sorted(r["task"] for r in sizes.collect() if r["n"] >= min_rows)  # few tasks
    binned = model.transform(labelled.where(F.col("task").isin(kept)))
    if not binary and fit_bins_on == "all":
        binned = binned.withColumn("label_bin", F.col(LABEL_COL + "_bin").cast("double"))
    label_cols = [c for c in (LABEL_COL, LABEL_COL + "_bin", "label_bin") if c in binned.columns]
    train = F.coalesce(hash_unit(ID_COL, SPLIT_HASH_PART) < F.lit(float(train_share)), F.lit(False))
    narrow = binned.select("task", ID_COL, *label_cols, train.alias("train"), *model.feature_names())
    path = shared_scratch(spark, "tasks")
    narrow.write.partitionBy("task").parquet(path)
    if sampler == "bernoulli":
        tasks.unpersist()
    schema = narrow.schema
    rows = spark.read.schema(schema).parquet(path).select(*narrow.columns) if kept else spark.createDataFrame([], schema)
    return Prepared(path, rows, model, time.perf_counter() - t0, kept)


def prepare(flows: DataFrame, binary: bool, **settings) -> tuple[DataFrame, BinningModel, float]:
    """:func:`prepare_tasks` as (binned rows, model, bin seconds)."""
    done = prepare_tasks(flows, binary, **settings)
    return done.rows, done.model, done.seconds


def run_key(**settings) -> str:
    """The name of a sweep: equal settings on an equally named data set give an equal key."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _fit_all(jobs: list[tuple[str, int, list[str]]], train: DataFrame, size: tuple[int, int], params: dict, at_once: int) -> tuple[dict, Exception | None]:
    """Models by (kind, prefix) with their seconds, fitted ``at_once`` at a time; the first failure.

    ``train`` has counted rows, and ``size`` the number of rows counted and of its own.
    """
    sc = train.sparkSession.sparkContext

    def fit(job: tuple[str, int, list[str]]):
        kind, n, cols = job
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{kind}-{n}")
        kept = None
        try:
            t0 = time.perf_counter()
            own = params.get(kind, {})
            rows, kept = rows_to_fit(train, cols, *size, 1 if single_rows(kind, own) else None)
            model = fit_model(kind, rows, cols, weight_col=WEIGHT, **own)
            return model, time.perf_counter() - t0
        finally:
            if kept is not None:
                kept.unpersist()
            sc.setLocalProperty("spark.scheduler.pool", None)

    done, failed = {}, None
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        futures = {(kind, n): pool.submit(fit, (kind, n, cols)) for kind, n, cols in jobs}
        for key, f in futures.items():
            try:
                done[key] = f.result()
            except Exception as e:  # what the other fits have done is kept; raised by the caller
                failed = failed or e
    return done, failed


def run_experiment(flows: DataFrame, binary: bool, models: Sequence[str] = ("rf",),
                   prefixes: Sequence[int] = PREFIX_SIZES, attack_pct: float = 0.3,
                   num_top_labels: int = 10, tactics: Sequence[str] | None = None,
                   min_rows: int = MIN_TASK_ROWS, dataset: str = "", split: str = "hash",
                   results_path: str | None = None, model_params: dict | None = None,
                   config: BinningConfig | None = None, fit_bins_on: str = "all",
                   sampler: str = "hash", parallel: int = PARALLEL_FITS) -> DataFrame:
    """Tasks x feature prefixes x models; one results row per model fit.

    With ``results_path`` the rows of a task are committed there as soon as it is scored, each
    under the sweep's :func:`run_key` and its own name.  A sweep with the same settings skips
    what is committed and returns its rows with the new ones.  If a fit fails, those that have
    ended are scored and committed before the failure is raised.  ``test_time`` is a model's
    share of the pass that scores all models of its task.
    """
    if fit_bins_on == "train" and split != "hash":
        raise ValueError("fit_bins_on='train' needs the deterministic hash split")
    check_models(models, binary)
    spark = flows.sparkSession
    params = model_params or {}
    sink, done = None, {}
    if results_path:
        key = run_key(dataset=dataset, binary=binary, attack_pct=attack_pct, num_top_labels=num_top_labels, tactics=tactics, min_rows=min_rows,
                      split=split, params={k: params[k] for k in sorted(params)}, config=dataclasses.asdict(config or BinningConfig()), fit_bins_on=fit_bins_on, sampler=sampler)
        sink = ResultsSink(spark, results_path, key)
        done = sink.committed()
    start = datetime.datetime.now().strftime("%H:%M:%S")
    ready = prepare_tasks(flows, binary, attack_pct, num_top_labels, tactics, min_rows, config, fit_bins_on, sampler=sampler)
    try:
        rows = [row for task in ready.tasks for row in _run_task(ready, task, binary, models, prefixes, split, params, parallel, start, dataset, attack_pct, sink, done)]
    finally:
        ready.release()
    return results_frame(spark, rows)


def _run_task(ready: Prepared, task: str, binary: bool, models: Sequence[str], prefixes: Sequence[int], split: str, params: dict, parallel: int,
              start: str, dataset: str, attack_pct: float, sink: ResultsSink | None, done: dict) -> list[tuple]:
    """The results rows of one task, those committed before among them."""
    one = ready.task(task)
    columns = {n: feature_columns(one, n) for n in prefixes}
    names = {(kind, n): ResultsSink.name(task, kind, n) for n in prefixes for kind in models}
    todo = [(kind, n, columns[n]) for (kind, n), name in names.items() if name not in done]
    rows = {k: done[name] for k, name in names.items() if name in done}
    failed = None
    if todo:
        wide = sorted({c for _, _, cols in todo for c in cols}, key=one.columns.index)
        if split != "hash":  # the caller's order of rows decides random_split, so it stays as read
            sides = random_split(one)
            one = sides[0].withColumn("train", F.lit(True)).unionByName(sides[1].withColumn("train", F.lit(False)))
        counted, path = store(equal_rows(one, ["train", "label_bin", *wide]), "counted")
        size = {r["train"]: (int(r["n"]), int(r["m"])) for r in counted.groupBy("train").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("m")).collect()}  # two rows
        train, test = (counted.where(side).drop("train") for side in ("train", "NOT train"))
        seen = {r["cname"]: int(r["u"]) for r in distinct_state(train, wide).collect()}  # one row a feature
        fitted, failed = _fit_all(todo, train, size.get(True, (0, 0)), params, parallel)
        t0 = time.perf_counter()
        models_of = {k: (model, columns[k[1]]) for k, (model, _) in fitted.items()}
        scored = score_models(models_of, test.repartition(parts_of(test.sparkSession, size.get(False, (0, 0))[1])), count_col="k")
        share = (time.perf_counter() - t0) / max(1, len(fitted))
        for (kind, n), (_, seconds) in fitted.items():
            cm = scored[kind, n]
            m = metrics_from_confusion(cm_frame(ready.rows, cm)).first()
            cols = columns[n]
            row = (start, dataset, task, kind, float(attack_pct), len(cols), cols, confusion_matrix(cm),
                   m["accuracy"], m["precision"], m["recall"], m["f_measure"], m["auc_hard"] if (binary or kind == "gbt") else None,
                   m["true_positive"], m["false_positive"], ready.seconds, seconds, share, [seen.get(c, 0) for c in cols])
            rows[kind, n] = row
            if sink is not None:
                sink.commit(names[kind, n], row)
        remove_path(ready.rows.sparkSession, path)
    if failed is not None:
        raise failed
    return [rows[kind, n] for n in prefixes for kind in models]


def cm_frame(like: DataFrame, cells: list) -> DataFrame:
    """A collected confusion table (classes^2 rows) as a DataFrame."""
    return like.sparkSession.createDataFrame([(c["label"], c["prediction"], c["n"]) for c in cells], "label double, prediction double, n long")
