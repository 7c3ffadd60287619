"""Session-level helpers shared by all operators.

Nothing here creates a session: callers hand one in.  The helpers only read
settings from it (checkpoint folder, warehouse folder) and pick how an
intermediate result is kept.
"""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "flowbin", partitions: int = 8, cores: str = "*") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - connect sessions have no SparkContext
        return None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint folder; set ``fallback`` only where none is set (tests)."""
    d = checkpoint_dir(spark)
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return d
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Keep an intermediate result that later jobs read several times.

    With a shared checkpoint folder the result is checkpointed (lineage cut,
    survives executor loss); otherwise it is persisted to memory and disk and
    can be recomputed from lineage.  Never a local checkpoint.
    """
    spark = df.sparkSession
    d = checkpoint_dir(spark)
    if d:
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:  # pragma: no cover - sessions without a SparkContext
            pass
        return df.checkpoint(eager=eager)
    return keep(df, eager)


def keep(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cache a short-lived intermediate (memory and disk).

    For small, short-lineage tables (value counts, confusion tables) that a
    few jobs of one fit read: a lost partition is recomputed from its short
    lineage, so writing them to the shared folder would only add I/O.
    Tables that live long or feed many later jobs go through
    :func:`materialize`.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        kept.count()
    return kept


def work_dir(spark: SparkSession) -> str:
    """The folder for tables between jobs: the session's checkpoint folder.

    Where none is set, a cluster uses its warehouse, which all executors share, and a
    session of one machine (``local``) a folder of its own, set as its checkpoint folder.
    """
    d = checkpoint_dir(spark)
    if d is None:
        master = spark.conf.get("spark.master", "")
        if master == "local" or master.startswith("local["):
            d = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="flowbin-"))
        else:
            d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_flowbin"
    return d.rstrip("/")


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under :func:`work_dir`."""
    return f"{work_dir(spark)}/_flowbin/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder on whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; the table, lineage cut, and its path.

    For tables that later jobs read by column, or that live as long as a fitted model.
    """
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once a session.

    Needed where the workers do not find it by themselves: another working folder, or a
    cluster that was not given it with ``--py-files``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_flowbin_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="flowbin-")) / "flowbin_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._flowbin_shipped = True


def force(df: DataFrame) -> None:
    """Run the whole plan of ``df`` without collecting it (noop sink)."""
    df.write.format("noop").mode("overwrite").save()
