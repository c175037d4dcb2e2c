"""Intermediate tables in the folder that the cluster shares.

A staged table cuts the lineage and outlives an executor. It is dropped as soon as nothing
reads it any more, at the latest when the driver's JVM ends.
"""

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of up to some 100 bytes that may be broadcast to meet whole texts.
MAX_BROADCAST = 1_000_000
#: Whether shuffle files go at the end of an execution.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="leadmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/leadmill-{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


@dataclass
class Staged:
    df: DataFrame
    path: str

    def drop(self) -> None:
        remove(self.df.sparkSession, self.path)


def stage(df: DataFrame, name: str) -> Staged:
    """Write df once and give the table that was written.

    Nothing reads the shuffles behind it any more, so their files go at the end of the write. Without
    that, Spark removes them once the driver's garbage collector has found that nothing refers to
    them, which is while the next table is written; other leftovers still need the collector.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    spark._jvm.System.gc()
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def to_texts(keys: DataFrame, name: str, rows: Column | None = None) -> DataFrame:
    """Keys (and a few bytes each) that texts will be joined to.

    Up to MAX_BROADCAST rows are broadcast, so that texts stay where they are; more are joined
    by a shuffle. A longer row counts as several `rows`.
    """
    kept = stage(keys, name).df
    count = kept.count() if rows is None else kept.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(kept) if count <= MAX_BROADCAST else kept
