"""Where operators keep the tables between their jobs: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def _files(spark: SparkSession, path: str):
    """The file system that ``path`` is on, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in the folder; none if it does not exist."""
    files, where = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


class Workspace:
    """Parquet tables of one run of an operator, under the shared folder.

    A table that is written cuts lineage: what reads it later does not depend on
    shuffle files of executors that may be gone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.id = f"{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_root(spark)}/tessellar/{self.id}"
        self._tables: dict[str, str] = {}
        self._written: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as ``name`` and read it back without any knowledge of its partitioning."""
        self._written.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Write ``df`` in ``buckets`` files hashed and sorted by ``key``; later grouping by it needs no shuffle."""
        table = f"tessellar_{self.id}_{name}"
        self._written.add(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (
            df.repartition(buckets, key)
            .write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", self.path(name))
            .mode("overwrite")
            .saveAsTable(table)
        )
        self._tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._written.discard(name)
            if name in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")
            delete(self.spark, self.path(name))

    def keep_only(self, *names: str) -> None:
        """Delete all tables but those that the result reads."""
        self.drop(*(self._written - set(names)))

    def close(self) -> None:
        """Delete the whole folder, when the result has been read or written elsewhere."""
        self.drop(*list(self._written))
        delete(self.spark, self.root)
