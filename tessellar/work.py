"""Folders that the cluster shares, and how small inputs are spread over it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: An input with less than this for each core is in too few splits to keep the cores busy.
SPLIT_BYTES = 128 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own (local mode only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="tessellar-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def files_at(spark: SparkSession, path: str):
    """The file system that ``path`` is on, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = files_at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = files_at(spark, path)
    files.delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores (by ``keys``), if it is read from fewer files than there are cores and is small.

    Larger inputs come in enough splits by themselves and are left where they are: no
    shuffle of texts is ever planned for them.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not files or len(files) >= cores or size > cores * SPLIT_BYTES:
        return df
    return df.repartition(cores, *keys)
