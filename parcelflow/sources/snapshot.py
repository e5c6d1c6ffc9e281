"""The snapshot sink: all tables of one commit in a new folder, and a pointer that is written last."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; a local one only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = _own.get(spark.sparkContext.applicationId) or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{found}/{name}-{uuid.uuid4().hex}"


def write_snapshot(frames: dict[str, DataFrame], root: str, commit: int, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write the frames under ``root/commit=<n>``; readers see them once the pointer row is there.

    Writing the same commit again replaces it, so that a batch that is retried stays one batch.
    """
    folder = f"{root}/data/commit={commit:012d}"
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}")
    spark = next(iter(frames.values())).sparkSession
    pointer = spark.range(1).select(F.lit(commit).cast("long").alias("commit_id"), F.lit(folder).alias("folder"))
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/commit_{commit:012d}")
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is directly in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current_folder(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest finished commit."""
    if not path_exists(spark, f"{root}/pointer"):
        return None
    newest = spark.read.parquet(f"{root}/pointer/*").agg(F.max_by("folder", "commit_id").alias("folder")).first()
    return newest["folder"] if newest else None


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    folder = current_folder(spark, root)
    return None if folder is None else spark.read.parquet(f"{folder}/{name}")
