"""Tables in the shared folder of the cluster: cutting lineage so that a lost executor costs no recomputation.

The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset and the master is
local (tests, a laptop) one is made under the system's temporary folder and set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; made and set only where the session has none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="teleloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def create_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Creates a small file unless there is one; false if there is. Of several writers one succeeds.

    Elsewhere than on a local disk this rests on the file system refusing to create an existing file (as HDFS does);
    there a file may be incomplete if its writer dies, which readers must be able to tell.
    """
    fs, p = _filesystem(spark, path)
    local = p.toUri().getPath() if (p.toUri().getScheme() or fs.getUri().getScheme()) == "file" else None
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, local)  # atomic, and fails where there is a file
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(data))
    out.close()
    return True


class Workspace:
    """A folder of intermediate tables of one run.

    ``put`` writes a DataFrame and gives it back read from there: the plan starts anew at the files, which every
    executor can read. ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Stores a table, in a folder for each value of column ``by`` if one is named."""
        write = df.write.mode("overwrite")
        (write.partitionBy(by) if by else write).parquet(self.path(name))
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files give fewer: before costly work on each row.

    Large inputs have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
