"""Parquet scans that know their row groups.

Spark cuts files into splits by bytes, but a row group is read by the one split that holds its
middle, so a file of one row group is one task's work whatever ``maxPartitionBytes`` says.
``read_parquet`` counts the splits that will hold rows; where they are fewer than the cores, the
rows are dealt out once over the cores, after the columns that the query leaves out are pruned
(Catalyst moves the projection below the exchange).  A source of many files or row groups gets
no exchange, and its footers are not read: as many files as cores are proof enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows for each core below which an exchange would cost more than it spreads.
WORTH_ROWS = 4_000


def _bytes(spark: SparkSession, key: str, default: str) -> int:
    text = spark.conf.get(key, default)
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def row_groups(spark: SparkSession, file: str) -> tuple[int, list[tuple[int, int]], int]:
    """A file's length, the first byte and length of its row groups, and its rows, from the footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        groups = reader.getRowGroups()
        return source.getLength(), [(g.getStartingPos(), g.getCompressedSize()) for g in groups], reader.getRecordCount()
    finally:
        reader.close()


def full_splits(files: list[tuple[int, list[tuple[int, int]], int]], split_bytes: int) -> int:
    """Splits that hold the middle of a row group."""
    return sum(len({(start + size // 2) // split_bytes for start, size in groups}) for _, groups, _ in files)


def split_bytes(spark: SparkSession, lengths: list[int], cores: int) -> int:
    """The size of Spark's file splits: by core, between the open cost and the configured most."""
    most, cost = _bytes(spark, "spark.sql.files.maxPartitionBytes", "128m"), _bytes(spark, "spark.sql.files.openCostInBytes", "4m")
    return max(1, min(most, max(cost, sum(n + cost for n in lengths) // cores)))


def read_parquet(spark: SparkSession, path: str, cores: int | None = None) -> DataFrame:
    """The table, dealt out over the cores where its own splits would leave cores without rows."""
    df = spark.read.parquet(path)
    cores = cores or spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if cores < 2 or not files or len(files) >= cores:
        return df
    footers = [row_groups(spark, f) for f in files]  # fewer files than cores
    rows = sum(n for _, _, n in footers)
    if rows < WORTH_ROWS * cores or full_splits(footers, split_bytes(spark, [n for n, _, _ in footers], cores)) >= cores:
        return df
    return df.repartition(cores)
