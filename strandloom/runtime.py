"""Session helpers shared by all operators: table loading, lineage cuts, sizing."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Python task of a co-locating operator should hold, at the most of one average partition.
ROWS_PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder of the context exists, a session in
    one process (local tests) makes a temporary folder; any other raises, since a folder of
    one machine is no shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    made = tempfile.mkdtemp(prefix="strandloom-")
    spark.sparkContext.setCheckpointDir(made)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut
    that outlives any executor. The table is dropped by :func:`release`, else when the
    session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _filesystem(spark, path)
    fs.deleteOnExit(target)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._strandloom_path = path
    return stored


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by :func:`materialize`."""
    path = getattr(df, "_strandloom_path", None)
    if path:
        fs, target = _filesystem(df.sparkSession, path)
        fs.delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def task_count(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions for a Python stage over ``rows`` rows: by volume, and no fewer than the session's width."""
    return max(shuffle_width(spark), math.ceil(rows / rows_per_task), 1)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan of fewer pieces than cores, dealt out to all cores; other scans are
    returned as they are. The result is the same either way."""
    cores = min(shuffle_width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark application."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_strandloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="strandloom-code-"), "strandloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._strandloom_shipped = True
